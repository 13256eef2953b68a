"""Drug names: doses stripped, the leading drug of a combination chosen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from therascape.functions.normalize import let, strip

# fixed values: agents that support, chemotherapy that accompanies, endings of targeted drugs, doses and schedules
SUPPORTIVE = [
    "dexamethasone", "prednisone", "prednisolone", "methylprednisolone", "hydrocortisone", "anticoagulant", "anticoagulants", "enoxaparin", "aspirin", "warfarin", "filgrastim", "pegfilgrastim", "g-csf",
    "ondansetron", "allopurinol", "folic acid", "folinic acid", "leucovorin", "vitamin b12", "placebo", "saline", "normal saline", "loperamide", "antihistamine", "acetaminophen", "paracetamol",
]
BACKBONE = [
    "carboplatin", "cisplatin", "oxaliplatin", "cyclophosphamide", "ifosfamide", "docetaxel", "paclitaxel", "nab-paclitaxel", "abraxane", "doxorubicin", "epirubicin", "daunorubicin", "liposomal doxorubicin",
    "gemcitabine", "pemetrexed", "fluorouracil", "5-fu", "5-fluorouracil", "capecitabine", "etoposide", "vincristine", "vinblastine", "vinorelbine", "irinotecan", "topotecan", "methotrexate", "cytarabine",
    "bendamustine", "mitomycin", "temozolomide", "dacarbazine", "fludarabine", "melphalan", "busulfan", "nab paclitaxel",
]
TARGETED_END = r"(?:mab|nib|tinib|ciclib|parib|lisib|degib|rafenib|sertib|metinib|demcizumab|ndb|dxd)$"
CODE_NAME = r"[A-Za-z]+[-]?\d"
CHEMO_END = r"(?:platin|rubicin)$"
DOSE = r"(?iU)\s+\d+(\.\d+)?\s?(mg|mcg|g|ml|mg/kg|mg/m2)\b.*"
SCHEDULE = r"(?iU)\s+(q\d?w|q\dd|qd|bid|tid|qw|iv|po|sc)\b.*"


def clean_name(name: Column) -> Column:
    """The name without dose and schedule."""
    return strip(F.regexp_replace(F.regexp_replace(strip(name), DOSE, ""), SCHEDULE, ""))


def weight(name: Column) -> Column:
    """3 for targeted drugs and code names, 2 for others, 1 for accompanying chemotherapy, 0 for supportive agents."""
    low = F.lower(name)
    code = name.rlike(CODE_NAME) & ~low.rlike(CHEMO_END)
    return F.when(low.isin(SUPPORTIVE), 0).when(low.isin(BACKBONE), 1).when(low.rlike(TARGETED_END) | code, 3).otherwise(2)


def lead_first(names: Column) -> Column:
    """Distinct cleaned names, the weightiest one (the earliest of equals) first, the others in order; [Unknown] if there is none."""

    def order(all_names: Column) -> Column:
        low = F.transform(all_names, F.lower)
        once = F.filter(all_names, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
        return let(once, lambda d: let(F.transform(d, weight), lambda w: let(F.array_position(w, F.array_max(w)).cast("int"), lambda p: F.concat(F.array(F.get(d, p - 1)), F.filter(d, lambda x, i: i + 1 != p)))))

    cleaned = F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: clean_name(F.coalesce(n, F.lit("")))), lambda n: n != "")
    return F.when(F.size(cleaned) == 0, F.array(F.lit("Unknown"))).otherwise(let(cleaned, order))
