"""Keyword dictionaries whose entries and order decide how texts are tagged."""

# fixed values: modality keywords in priority order
MODALITY = {
    "ADC": ["antibody-drug conjugate", "ADC", "DXd", "vc-MMAE", "SMCC", "conjugate"],
    "Bispecific Antibody": ["bispecific", "bsAb", "bispecific antibody", "tandem", "dual targeting", "CrossMAb"],
    "CAR-T": ["CAR-T", "CAR T-cell", "chimeric antigen receptor", "CAR T cell therapy"],
    "Monoclonal Antibody": ["monoclonal antibody", "mAb", "umab", "zumab", "ximab", "limab", "lumab", "tumab", "mumab"],
    "Fusion Protein": ["fusion protein", "fc fusion", "fc-fusion", "ligand trap", "vegf trap", "decoy receptor", "immunocytokine", "aflibercept", "luspatercept", "sotatercept", "rilonacept", "eftilagimod"],
    "Recombinant Protein": ["interferon", "interleukin", "aldesleukin", "denileukin"],
    "Cell Therapy": ["cell therapy", "NK cell", "TIL", "tumor infiltrating lymphocyte", "TCR-T", "cell injection", "cell infusion", "dendritic cell", "T cell therapy"],
    "Oncolytic Virus": ["oncolytic", "oncolytic virus", "oncolytic therapy"],
    "Vaccine": ["vaccine", "neoantigen", "neo-antigen", "neopeptide", "neo-epitope"],
    "Small Molecule": [
        "inhibitor", "tyrosine kinase inhibitor", "TKI", "small molecule", "kinase inhibitor", "antagonist", "inib", "afib", "rafenib", "citinib", "alanib", "nucleoside", "nucleotide analog", "azacitidine", "decitabine", "olomide", "mustard",
    ],
    "mRNA": ["mRNA", "messenger RNA", "mRNA vaccine", "mRNA therapy"],
    "Peptide": ["peptide", "cyclic peptide", "stapled peptide"],
    "Radiopharmaceutical": ["radiopharmaceutical", "radioligand", "PSMA", "lutetium", "actinium"],
}

# fixed values: target keywords matched as substrings, in order
TARGET = {
    "PD-1": ["anti-PD-1", "PD-1", "PD1", "pembrolizumab", "nivolumab", "tislelizumab", "sintilimab", "camrelizumab", "zimberelimab"],
    "PD-L1": ["anti-PD-L1", "PD-L1", "PDL1", "atezolizumab", "durvalumab", "avelumab"],
    "HER2": ["HER2", "HER-2", "ErbB2", "trastuzumab", "pertuzumab", "tucatinib"],
    "EGFR": ["EGFR", "epidermal growth factor receptor", "osimertinib", "erlotinib", "gefitinib", "afatinib", "lazertinib"],
    "VEGF/VEGFR": ["VEGF", "VEGFR", "bevacizumab", "anti-angiogenic", "ramucirumab", "axitinib", "lenvatinib", "sunitinib"],
    "TROP2": ["TROP2", "TROP-2", "trophoblast cell surface antigen"],
    "CLDN18.2": ["Claudin 18.2", "CLDN18.2", "Claudin18.2", "zolbetuximab"],
    "CTLA-4": ["CTLA-4", "CTLA4", "ipilimumab", "tremelimumab"],
    "CD19": ["CD19", "anti-CD19"],
    "CD20": ["CD20", "anti-CD20", "rituximab", "obinutuzumab", "ofatumumab"],
    "BCMA": ["BCMA", "B-cell maturation antigen"],
    "MET": ["c-MET", "anti-MET", "MET amplification", "MET exon 14", "MET inhibitor", "crizotinib", "capmatinib", "tepotinib", "savolitinib"],
    "KRAS": ["KRAS", "KRAS G12C", "sotorasib", "adagrasib"],
    "ALK": ["anaplastic lymphoma kinase", "ALK inhibitor", "ALK fusion", "ALK rearrangement", "alectinib", "brigatinib", "lorlatinib"],
    "FGFR": ["FGFR", "fibroblast growth factor receptor", "erdafitinib", "pemigatinib"],
    "IDH1/2": ["IDH1", "IDH2", "isocitrate dehydrogenase", "enasidenib", "ivosidenib"],
    "CDK4/6": ["CDK4/6", "CDK 4/6", "palbociclib", "ribociclib", "abemaciclib"],
    "PARP": ["PARP inhibitor", "poly ADP-ribose", "olaparib", "niraparib", "rucaparib"],
    "RET": ["RET fusion", "RET mutation", "RET inhibitor", "selpercatinib", "pralsetinib"],
    "NTRK": ["NTRK", "TRK fusion", "tropomyosin receptor kinase", "larotrectinib", "entrectinib"],
    "BTK": ["BTK", "Bruton", "ibrutinib", "acalabrutinib", "zanubrutinib"],
    "BCL2": ["BCL-2", "BCL2", "venetoclax", "navitoclax"],
}

# fixed values: target abbreviations matched as whole words, after the substrings
TARGET_WORDS = {"MET": ["MET"], "ALK": ["ALK"], "CDK4/6": ["CDK4", "CDK6"], "PARP": ["PARP"], "RET": ["RET"], "BTK": ["BTK"], "BCL2": ["BCL-2", "BCL2"]}

# fixed values: biomarkers as substrings, then as whole words
BIOMARKER = [
    "PD-L1", "HER2", "TROP2", "CLDN18.2", "tumor mutational burden", "MSI-H", "microsatellite instability", "mismatch repair", "dMMR", "EGFR mutation", "KRAS", "BRAF", "ROS1", "NTRK", "biomarker", "biomarker-selected", "biomarker analysis", "companion diagnostic", "CDx", "genomic", "molecular profiling",
]
BIOMARKER_WORDS = ["RET", "MET", "ALK", "TMB", "MSI", "ER", "PR", "AR"]

# fixed values: cancer categories by whole words, in order
CANCER = {
    "Lung": ["lung", "NSCLC", "SCLC", "non-small cell", "small cell lung", "pulmonary"],
    "Colorectal": ["colorectal", "colon", "rectal", "rectum", "CRC"],
    "Gastric": ["gastric", "stomach", "gastroesophageal", "GEJ"],
    "Breast": ["breast"],
    "Hematologic": [
        "lymphoma", "leukemia", "myeloma", "AML", "CLL", "CML", "NHL", "ALL", "myelodysplastic", "myeloproliferative", "myelofibrosis", "lymphoproliferative", "hematologic", "haematologic", "hematological", "haematological", "polycythemia", "polycythaemia", "waldenstrom", "aplastic anemia", "aplastic anaemia", "mastocytosis",
    ],
    "Liver": ["hepatocellular", "liver", "HCC", "cholangiocarcinoma", "biliary", "bile duct"],
    "Pancreatic": ["pancreatic", "pancreas"],
    "Prostate": ["prostate", "prostatic"],
    "Ovarian": ["ovarian", "ovary", "fallopian tube"],
    "Bladder": ["bladder", "urothelial"],
    "Melanoma": ["melanoma"],
    "Skin": ["basal cell", "merkel cell", "actinic keratosis", "actinic keratoses", "cutaneous squamous"],
    "Head & Neck": ["head and neck", "HNSCC", "nasopharyngeal", "thyroid", "laryngeal", "oropharyngeal", "hypopharyngeal", "salivary"],
    "Esophageal": ["esophageal", "esophagus", "oesophag"],
    "Endometrial": ["endometrial", "uterine", "cervical", "endometrium"],
    "Renal": ["renal", "kidney", "RCC"],
    "Sarcoma": ["sarcoma", "gastrointestinal stromal", "GIST"],
    "Glioma": ["glioma", "glioblastoma", "GBM", "brain", "neuroblastoma", "medulloblastoma"],
    "Neuroendocrine": ["neuroendocrine", "carcinoid", "pheochromocytoma", "paraganglioma"],
    "Mesothelioma": ["mesothelioma"],
    "Solid Tumor": ["solid tumor", "solid tumour", "solid neoplasm", "solid malignan", "solid cancer"],
    "Cancer (NOS)": ["cancer", "carcinoma", "neoplasm", "tumor", "tumour", "malignan", "oncolog"],
}

# fixed values: trial status and phase buckets, phase weights
ONGOING = ["RECRUITING", "ACTIVE_NOT_RECRUITING", "NOT_YET_RECRUITING", "ENROLLING_BY_INVITATION"]
COMPLETED = ["COMPLETED"]
STOPPED = ["TERMINATED", "WITHDRAWN", "SUSPENDED"]
PHASE = {"EARLY_PHASE1": "P1", "PHASE1": "P1", "PHASE1/PHASE2": "P1/2", "PHASE2": "P2", "PHASE2/PHASE3": "P2/3", "PHASE3": "P3", "PHASE4": "P4"}
PHASE_WEIGHT = {"P1": 1.0, "P1/2": 1.5, "P2": 2.0, "P2/3": 2.5, "P3": 3.0, "P4": 4.0}
PRECLINICAL_WEIGHT = 0.3
