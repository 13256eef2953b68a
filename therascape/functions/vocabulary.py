"""Synonyms, aliases, codes and patterns by which names are normalised."""

# fixed values: target synonyms
TARGET_SYNONYMS = {
    "ERBB2": "HER2", "HER-2": "HER2", "HER2/neu": "HER2", "neu": "HER2", "ERBB2/HER2": "HER2", "HER2/ERBB2": "HER2", "HER2neu": "HER2",
    "ERBB1": "EGFR", "HER1": "EGFR", "ERBB3": "HER3",
    "PDCD1": "PD-1", "PD1": "PD-1", "PD-L1/PD-1": "PD-1", "PD-1/PD-L1": "PD-1", "PDL1": "PD-L1", "CD274": "PD-L1", "PD-L1/PD-L2": "PD-L1",
    "CTLA4": "CTLA-4", "LAG3": "LAG-3", "CD137": "4-1BB",
    "RAS": "KRAS", "KRAS G12C": "KRAS", "KRASG12C": "KRAS", "KRAS G12D": "KRAS", "KRASG12D": "KRAS",
    "VEGF-A": "VEGF/VEGFR", "VEGFA": "VEGF/VEGFR", "VEGF": "VEGF/VEGFR", "VEGFR": "VEGF/VEGFR", "VEGFR2": "VEGF/VEGFR", "KDR": "VEGF/VEGFR",
    "VEGF/VEGFR2": "VEGF/VEGFR", "VEGFR3": "VEGF/VEGFR", "FLT4": "VEGF/VEGFR",
    "MEK1": "MEK", "MEK2": "MEK", "MAP2K1": "MEK", "ERK1": "ERK", "ERK2": "ERK", "ERK1/2": "ERK", "MAPK1": "ERK", "MAPK3": "ERK",
    "PARP1": "PARP", "PARP-1": "PARP", "CD3E": "CD3", "cMET": "MET", "C-MET": "MET", "HGFR": "MET",
    "TROP-2": "TROP2", "TACSTD2": "TROP2", "Trop2": "TROP2", "CDK4": "CDK4/6", "CDK6": "CDK4/6", "PI3Kα": "PIK3CA",
    "TP53": "p53", "CTNNB1": "β-catenin", "Topoisomerase I": "TOP1", "TOPO I": "TOP1", "TOP1MT": "TOP1", "CEACAM5": "CEA", "GCC": "GUCY2C",
    "Akt": "AKT", "BCL-2": "BCL2", "MCL-1": "MCL1", "Mcl-1": "MCL1", "B7H3": "B7-H3", "CSF-1R": "CSF1R",
    "TGF-beta": "TGF-β", "TGFβ": "TGF-β", "TGF-B": "TGF-β", "tubulin": "Tubulin", "HIF-1a": "HIF-1α",
}
TARGET_JUNK = ["DNA", "RNA", "N/A", "NONE", "-", "TUMOR", "CANCER", "MULTIPLE"]
KRAS_MUTATION = r"(?i)^k-?ras[\s\-]?(g12[a-z]|g13[a-z]|q61[a-z]|a146[a-z])$"
ERBB = r"(?i)^(?:wt)?erbb[\s\-]?([123])[a-z]?$"
ERBB_TARGET = {"1": "EGFR", "2": "HER2", "3": "HER3"}

# fixed values: target symbols by their letters and digits, for names that a model gives
TARGET_CANON = {
    "bcrabl": "BCR-ABL", "bcrabl1": "BCR-ABL", "abl": "BCR-ABL", "abl1": "BCR-ABL", "her2": "HER2", "her2neu": "HER2", "erbb2": "HER2", "her3": "HER3", "erbb3": "HER3",
    "pdl1": "PD-L1", "pd1": "PD-1", "pdl2": "PD-L2", "ctla4": "CTLA-4",
    "vegf": "VEGF/VEGFR", "vegfr": "VEGF/VEGFR", "vegfr2": "VEGF/VEGFR", "vegfvegfr": "VEGF/VEGFR", "kdr": "VEGF/VEGFR",
    "egfr": "EGFR", "met": "MET", "cmet": "MET", "alk": "ALK", "ros1": "ROS1", "ret": "RET", "ntrk": "NTRK", "trk": "NTRK",
    "kras": "KRAS", "krasg12c": "KRAS G12C", "nras": "NRAS", "hras": "HRAS", "ras": "RAS", "braf": "BRAF", "brafv600e": "BRAF V600E",
    "cdk46": "CDK4/6", "cdk4": "CDK4/6", "cdk6": "CDK4/6", "cdk7": "CDK7", "cdk9": "CDK9", "parp": "PARP", "parp1": "PARP", "btk": "BTK", "bcl2": "BCL2",
    "fgfr": "FGFR", "fgfr2": "FGFR2", "fgfr3": "FGFR3", "fgfr2b": "FGFR2b", "pi3k": "PI3K", "pik3ca": "PIK3CA", "akt": "AKT", "akt1": "AKT", "mtor": "mTOR",
    "idh1": "IDH1", "idh2": "IDH2", "idh12": "IDH1/2", "idh1idh2": "IDH1/2", "tp53": "TP53", "p53": "TP53", "mdm2": "MDM2", "mdmx": "MDMX",
    "trop2": "TROP2", "cldn182": "CLDN18.2", "claudin182": "CLDN18.2", "bcma": "BCMA", "cd19": "CD19", "cd20": "CD20", "cd22": "CD22", "cd3": "CD3",
    "cd30": "CD30", "cd33": "CD33", "cd38": "CD38", "cd123": "CD123", "psma": "PSMA", "fap": "FAP", "dll3": "DLL3", "muc16": "MUC16", "msln": "Mesothelin",
    "mesothelin": "Mesothelin", "nectin4": "Nectin-4", "gd2": "GD2", "cea": "CEA", "tigit": "TIGIT", "lag3": "LAG-3", "tim3": "TIM-3", "ar": "AR",
    "topoisomeraseii": "Topoisomerase II", "topoisomerasei": "Topoisomerase I", "topoisomerase": "Topoisomerase", "proteasome": "Proteasome", "26sproteasome": "Proteasome",
    "farnesyltransferase": "Farnesyltransferase", "imid": "Cereblon (IMiD)", "crbn": "Cereblon (IMiD)", "hdac": "HDAC", "hsp90": "HSP90", "mek": "MEK", "raf": "RAF", "kit": "KIT",
    "csf1r": "CSF1R", "jak": "JAK", "jak12": "JAK1/2", "jak2": "JAK2", "her2low": "HER2", "estrogenreceptor": "ER", "er": "ER", "pr": "PR",
}
DRUG_AS_TARGET = {
    "bortezomib": "Proteasome", "carfilzomib": "Proteasome", "ixazomib": "Proteasome", "marizomib": "Proteasome", "oprozomib": "Proteasome",
    "lenalidomide": "Cereblon (IMiD)", "pomalidomide": "Cereblon (IMiD)", "thalidomide": "Cereblon (IMiD)", "iberdomide": "Cereblon (IMiD)",
    "azacitidine": "DNMT", "decitabine": "DNMT", "everolimus": "mTOR", "temsirolimus": "mTOR", "venetoclax": "BCL2", "vismodegib": "Hedgehog (SMO)", "sonidegib": "Hedgehog (SMO)",
}
TARGET_RESCUE = {
    "proteasome": "Proteasome", "topoisomerase ii": "Topoisomerase II", "topoisomerase": "Topoisomerase", "farnesyltransferase": "Farnesyltransferase",
    "glucocorticoid": "Glucocorticoid receptor", "microtubule": "Microtubule", "dna methyltransferase": "DNMT", "dnmt": "DNMT", "cereblon": "Cereblon (IMiD)",
    "histone deacetylase": "HDAC", "aurora": "Aurora kinase",
}
SENTENCE_MARKS = [" is a ", "therefore", "does not have", "inhibitor", "not a single", ";", ":"]

# fixed values: biomarker synonyms by letters and digits, and words that name no biomarker
BIOMARKER_CANON = {
    "msi": "MSI-H", "msih": "MSI-H", "microsatelliteinstability": "MSI-H", "dmmr": "dMMR", "mismatchrepair": "dMMR", "mmrd": "dMMR",
    "tmb": "TMB", "tumormutationalburden": "TMB", "tmbhigh": "TMB", "pdl1": "PD-L1", "her2": "HER2", "egfrmutation": "EGFR mutation", "hrd": "HRD",
}
BIOMARKER_JUNK = ["biomarker", "biomarker analysis", "biomarker-selected", "genomic", "molecular profiling", "oncology", "ngs"]

# fixed values: biomarker aliases in lower case
BIOMARKER_ALIAS = {
    "erbb2": "HER2", "her-2": "HER2", "her2/neu": "HER2", "her-2/neu": "HER2", "c-erbb-2": "HER2", "c-erbb2": "HER2", "her2neu": "HER2", "neu": "HER2", "her2-neu": "HER2", "her2 neu": "HER2",
    "c-met": "MET", "cmet": "MET", "c met": "MET", "pdl1": "PD-L1", "pd l1": "PD-L1", "pdl-1": "PD-L1", "cd274": "PD-L1", "pd1": "PD-1", "pdcd1": "PD-1", "pdl2": "PD-L2",
    "microsatellite instability": "MSI", "microsatellite instability-high": "MSI-H", "msi high": "MSI-H", "msi-high": "MSI-H", "msi-l": "MSI-L", "msi-low": "MSI-L", "microsatellite stable": "MSS",
    "mismatch repair": "MMR", "mismatch repair deficiency": "dMMR", "mismatch repair deficient": "dMMR", "deficient mismatch repair": "dMMR", "mmr deficient": "dMMR", "mmr-d": "dMMR", "mmrd": "dMMR",
    "mismatch repair proficient": "pMMR", "mmr proficient": "pMMR", "mmr-p": "pMMR",
    "tumor mutational burden": "TMB", "tumour mutational burden": "TMB", "tmb-high": "TMB-H", "tmb high": "TMB-H", "tmb-h": "TMB-H",
    "estrogen receptor": "ER", "oestrogen receptor": "ER", "progesterone receptor": "PR", "androgen receptor": "AR", "hormone receptor": "HR", "estrogen receptor 1": "ESR1",
    "homologous recombination deficiency": "HRD", "homologous recombination repair": "HRR", "homologous recombination": "HRR",
    "circulating tumor dna": "ctDNA", "circulating tumour dna": "ctDNA", "ct-dna": "ctDNA", "ct dna": "ctDNA", "cf-dna": "cfDNA", "cf dna": "cfDNA",
    "ki-67": "Ki67", "ki 67": "Ki67", "mib-1": "Ki67", "mib1": "Ki67", "egfrviii": "EGFR", "egfr viii": "EGFR", "dmmr": "dMMR", "pmmr": "pMMR", "ctdna": "ctDNA", "cfdna": "cfDNA", "her2": "HER2",
}

# fixed values: endings of a biomarker that tell of its state
BIOMARKER_STATE_WORDS = (
    r"mutations?|mutant|mutated|mut|amplifications?|amplified|amp|deletions?|del|insertions?|ins|expressions?|overexpression|expressing|positive|negative|pos|neg|high|low|loss|gain|"
    r"fusions?|rearrangements?|rearranged|translocations?|status|alterations?|altered|variants?|wild[- ]?type|wt|aberrations?|aberrant|activating|inactivating|skipping|skip|genes?|"
    r"genetic|genomic|promoter|copy number|cnv|methylation|methylated|splice|splicing|hotspot"
)
BIOMARKER_TAILS = [
    rf"(?iU)[\s,/_+-]*\b(?:{BIOMARKER_STATE_WORDS})\b\.?$",
    r"(?iU)[\s,/_+-]*(?:viii|exon\s?\d+|ex\d+|del\s?\d+|ins\s?\d+|cps|tps|ihc\s?\d?\+?|fish|[0-3]\+)\.?$",
    r"[\s,/_-]+[A-Z]\d{2,4}[A-Z*](?:fs|del|dup|ins)?$",
    r"[\s,/_-]+p?\.?[A-Z]\d{2,4}[A-Z*]?(?:fs|del|dup|ins)?$",
]
BIOMARKER_JOINED = r"^([A-Z][A-Z0-9]{1,7}?)([A-Z]\d{2,4}[A-Z*])$"
BIOMARKER_SMALL_TAIL = r"(?<=[A-Z])(?:mut|mt|amp|del|wt|m)$"
#: A wider pattern of every ending above at the end of a name.
BIOMARKER_MAY_END = rf"(?iU)(?:{BIOMARKER_STATE_WORDS}|viii|\d|\+|cps|tps|ihc\s?|fish|[A-Z]\d{{2,4}}[A-Z*]?(?:fs|del|dup|ins)?|[A-Z](?:mut|mt|amp|del|wt|m))\.?$"
GENE = r"^[A-Za-z][A-Za-z0-9]{0,8}(?:-[A-Za-z0-9]+)?$"

# fixed values: states of a biomarker, the first that is found counts
BIOMARKER_STATES = {
    "amplification": r"amplif|\bamp\b",
    "skipping": r"skipping",
    "fusion": r"fusion|rearrang|translocation",
    "mutation": r"mutation|mutant|mutated|\bmut\b|activating|[A-Z]\d{2,4}[A-Z*]|exon\s?\d+|p\.[A-Z]\d",
    "overexpression": r"overexpress|expressing|\bihc\b|ihc\s?\d|\d\+|overexpression",
    "deletion": r"deletion|\bdel\b",
    "loss": r"\bloss\b|deficien",
    "wildtype": r"wild[- ]?type|\bwt\b",
    "low": r"\blow\b|-low",
    "high": r"\bhigh\b|-high",
    "negative": r"negative|\bneg\b|-negative",
    "positive": r"positive|\bpos\b|-positive",
}

# fixed values: what a name holds, in lower case, if it tells of a state
BIOMARKER_STATE_PARTS = {
    "amplification": ["amp"], "skipping": ["skipping"], "fusion": ["fusion", "rearrang", "translocation"], "mutation": ["mut", "activating"],
    "overexpression": ["overexpress", "expressing", "ihc", "+"], "deletion": ["del"], "loss": ["loss", "deficien"], "wildtype": ["wild", "wt"],
    "low": ["low"], "high": ["high"], "negative": ["neg"], "positive": ["pos"],
}

# fixed values: parts of an affiliation
SUBUNIT = (
    r"(?iU)^(the\s+)?(department|dept|division|divisione|faculty|school|section|unit|laboratory|lab|center for|centre for|programme?|service|chair|servicio|servizio|"
    r"dipartimento|abteilung|departement|departamento|institute of (molecular|clinical|cancer research|oncology))\b"
)
COMPANY_SUFFIX = r"(?i)^(inc|ltd|llc|gmbh|co|corp|corporation|company|ag|plc|s\.?a|sas|bv|pvt\.?\s*ltd|pvt|aps|oy|ab)\.?$"
INSTITUTION = (
    r"universit|college|hospital|institute|institut|cancer cent|medical cent|clinic|klinik|foundation|school of medicine|health system|health network|"
    r"centre|center|pharmaceutic|therapeutics|biosciences|biotech|laboratories|nhs|academy|clinica"
)
COMPANY_FIELD = r"\b(pharmaceuticals?|therapeutics|biosciences?|biopharma|biotech|oncology|genomics|medicines?|sciences?)\b"
COMPANY_FIELD_PARTS = ["pharmaceutical", "therapeutics", "bioscience", "biopharma", "biotech", "oncology", "genomics", "medicine", "science"]
INSTITUTION_CANON = {
    r"md anderson": "MD Anderson Cancer Center",
    r"sloan.?kettering|mskcc|memorial sloan": "Memorial Sloan Kettering Cancer Center",
    r"dana.?farber": "Dana-Farber Cancer Institute",
    r"moffitt": "Moffitt Cancer Center",
    r"mayo clinic": "Mayo Clinic",
    r"cleveland clinic": "Cleveland Clinic",
    r"massachusetts general": "Massachusetts General Hospital",
}
INSTITUTION_CANON_PARTS = {
    "MD Anderson Cancer Center": ["md anderson"], "Memorial Sloan Kettering Cancer Center": ["sloan", "mskcc"], "Dana-Farber Cancer Institute": ["dana"], "Moffitt Cancer Center": ["moffitt"],
    "Mayo Clinic": ["mayo clinic"], "Cleveland Clinic": ["cleveland clinic"], "Massachusetts General Hospital": ["massachusetts general"],
}
MULTI_CAMPUS = r"(?i)^University of (California|Texas|Colorado|Washington|Pittsburgh|Wisconsin)$"
UNIVERSITY_TAIL = (
    r"(?iU)^(.+?\buniversit\w*\b.*?)\s+(?:Health\s+System|Health\s+Network|Hospitals?|Medical\s+Cent(?:er|re)|College\s+of\s+Medicine|School\s+of\s+Medicine|Cancer\s+Cent(?:er|re)|Health)\s*$"
)
UNIVERSITY_SCHOOL = r"(?iU)^(.*\bUniversity)\s+(?:School|College|Faculty)\s+of\s+.+$"

# fixed values: states, territories and names of countries
US_STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY",
    "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND",
    "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
]
US_TERRITORIES = {"GU": "Guam", "PR": "Puerto Rico", "VI": "U.S. Virgin Islands", "AS": "American Samoa", "MP": "Northern Mariana Islands"}
COUNTRIES = {"Republic of Korea": "South Korea", "Korea, Republic of": "South Korea", "United States": "USA", "United States of America": "USA", "U.S.A": "USA", "US": "USA"}
COUNTRY_CODES = {
    "US": "USA", "GB": "United Kingdom", "CN": "China", "JP": "Japan", "DE": "Germany", "FR": "France", "IT": "Italy", "ES": "Spain", "CA": "Canada", "AU": "Australia",
    "KR": "South Korea", "NL": "Netherlands", "CH": "Switzerland", "SE": "Sweden", "BE": "Belgium", "DK": "Denmark", "AT": "Austria", "BR": "Brazil", "IN": "India",
    "IL": "Israel", "NO": "Norway", "FI": "Finland", "PL": "Poland", "RU": "Russia", "TR": "Turkey", "TW": "Taiwan", "SG": "Singapore", "HK": "Hong Kong", "IE": "Ireland",
    "PT": "Portugal", "GR": "Greece", "CZ": "Czech Republic", "MX": "Mexico", "AR": "Argentina", "ZA": "South Africa", "SA": "Saudi Arabia", "TH": "Thailand", "NZ": "New Zealand",
}

# fixed values: company names by the phrases that tell of them, in order
COMPANIES = [
    ("AstraZeneca", ["astrazeneca", "astra zeneca", "medimmune"]),
    ("Daiichi Sankyo", ["daiichi sankyo", "daiichi"]),
    ("Merck KGaA", ["merck kgaa", "emd serono", "healthcare business of merck", "merck healthcare", "merck, s.l", "merck serono"]),
    ("Merck (MSD)", ["merck sharp", "msd", "merck & co", "merck and co", "merck foundation"]),
    ("Roche/Genentech", ["hoffmann-la roche", "hoffmann la roche", "genentech", "roche"]),
    ("Pfizer", ["pfizer", "seagen", "seattle genetics"]),
    ("Bristol Myers Squibb", ["bristol myers squibb", "bristol-myers", "celgene", "juno therapeutics", "bms"]),
    ("Novartis", ["novartis"]),
    ("Johnson & Johnson", ["janssen", "johnson & johnson", "johnson and johnson", "j&j", "legend biotech"]),
    ("GSK", ["glaxosmithkline", "glaxosmithklin", "gsk"]),
    ("AbbVie", ["abbvie", "abbisko"]),
    ("Gilead Sciences", ["gilead", "kite pharma", "kite"]),
    ("Amgen", ["amgen"]),
    ("Sanofi", ["sanofi", "genzyme"]),
    ("Bayer", ["bayer"]),
    ("Takeda", ["takeda"]),
    ("BeiGene/BeOne", ["beigene", "beone medicines", "beone"]),
    ("Astellas", ["astellas"]),
    ("Eisai", ["eisai"]),
    ("Boehringer Ingelheim", ["boehringer"]),
    ("Eli Lilly", ["eli lilly", "loxo oncology", "loxo", "lilly"]),
    ("Regeneron", ["regeneron"]),
    ("Moderna", ["moderna"]),
    ("BioNTech", ["biontech"]),
    ("Incyte", ["incyte"]),
    ("Exelixis", ["exelixis"]),
    ("Jazz Pharmaceuticals", ["jazz pharma"]),
    ("Servier", ["servier"]),
    ("Taiho", ["taiho"]),
    ("Ipsen", ["ipsen"]),
    ("Merus", ["merus"]),
    ("Zymeworks", ["zymeworks"]),
    ("Arvinas", ["arvinas"]),
    ("Revolution Medicines", ["revolution medicines"]),
    ("Mirati", ["mirati"]),
    ("Blueprint Medicines", ["blueprint medicines"]),
    ("Deciphera", ["deciphera"]),
    ("Kura Oncology", ["kura oncology"]),
    ("Nuvation", ["nuvation"]),
    ("Summit Therapeutics", ["summit therapeutics"]),
    ("Bicara", ["bicara"]),
    ("HUTCHMED", ["hutchmed"]),
    ("Hengrui", ["hengrui"]),
    ("Innovent", ["innovent"]),
    ("Junshi", ["junshi"]),
    ("Akeso", ["akeso"]),
    ("Zai Lab", ["zai lab", "zailab"]),
    ("Shanghai Henlius", ["henlius"]),
    ("3SBio", ["3sbio"]),
    ("Kelun", ["kelun"]),
    ("Hansoh", ["hansoh"]),
    ("Yuhan", ["yuhan"]),
    ("Hanmi", ["hanmi"]),
    ("Samyang", ["samyang"]),
]
COMPANY_PATTERNS = {"Merck (MSD)": r"merck(?!\s*(?:kgaa|healthcare|serono|s\.l))"}
COMPANY_PATTERN_PARTS = {"Merck (MSD)": ["merck"]}
COMPANY_WHOLE_WORDS = ["msd", "bms", "gsk", "j&j", "lilly", "bayer", "roche", "kite", "loxo", "ipsen", "merus", "kelun", "yuhan", "hanmi", "akeso", "beone", "3sbio"]
COMPANY_BREAK = r"\s*[;|]\s*|\s+/\s+"
NOT_A_COMPANY = (
    r"(?iU)\b(?:universit\w*|college|school of medicine|medical school|hospital|clinic|cancer cent(?:er|re)|comprehensive cancer|medical cent(?:er|re)|"
    r"health (?:network|system|services|authority)|institut\w*|foundation|national (?:cancer|institute|university|health)|n\.c\.i|nci|nih|"
    r"research (?:cent(?:er|re)|institut\w*|hospital)|academ\w*|ministry|government|federal|consortium|cooperative group|society|association|department of|trials? group|alliance|network|"
    r"polyclinic|infirmary|klinik\w*|università|universidad|universit[ée]|universit[äa]t|centre hospitalier|assistance publique|gustave roussy|"
    r"m\.?d\.? anderson|sloan kettering|dana[- ]?farber|moffitt|mayo clinic|cleveland clinic|charit[ée])\b"
)
COMPANY_HINT = (
    r"(?iU)\b(?:inc|incorporated|ltd|limited|llc|gmbh|corp|corporation|co|ag|plc|s\.?a|sas|b\.?v|pvt|aps|oy|ab|s\.?r\.?l)\b"
    r"|\b(?:bio|pharma|biopharma|onco|therapeutic|biotech|biosci|genomic|medicine|diagnostic|biologic|biopharmaceutical)\w*"
)
LEGAL_TAIL = (
    r"(?iU)[\s,]*\b(?:inc(?:orporated)?|ltd|limited|llc|l\.l\.c\.|gmbh|corp(?:oration)?|company|co|ag|plc|s\.?a\.?s?|b\.?v\.?|pvt|aps|oy|ab|s\.?r\.?l\.?|group|holding(?:s)?)\b\.?\s*$"
)

# fixed values: vaccines known by code, texts that are no cancer vaccine or no cytokine, kinds that a gap fix may replace
VACCINE_CODES = ["neo-pv-01", "vb10.neo", "vb10", "gx-188e", "ose2101", "gen-009", "pgv-001"]
PREVENTIVE = r"(?iU)covid|sars-cov|influenza|\bflu\b|pneumococc|pneumonia|hepatitis|zoster|shingles|tetanus|diphther|pertussis|meningococc|\brabies\b|yellow fever|varicella|mrna-127"
ANTI_CYTOKINE = r"(?iU)\banti-?\s*(inter(leukin|feron)|il-?\d|ifn)"
DRUG_BREAK = r"(?iU)\s*(?:,|\+|/|\bplus\b|\band\b|\bwith\b)\s*"
DRUG_BREAK_PARTS = [",", "+", "/", "plus", "and", "with"]
PROTEIN_OVER = ["Small Molecule", "Unknown", "Peptide", "Monoclonal Antibody", ""]
VACCINE_OVER = ["Unknown", "mRNA", "Peptide", "Small Molecule", "Monoclonal Antibody", "ADC", "Bispecific Antibody", ""]

# fixed values: phrases of the companion-diagnostics score
CDX_CONDITIONS = ["colorectal", "gastric", "stomach", "colon", "rectal", "gastrointestinal", "gi", "crc", "gc"]
CDX_CONFIRMED = ["positive", "overexpression", "amplification", "mutation", "high expression", "selected", "must have", "required", "documented"]
