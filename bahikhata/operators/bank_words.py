"""Names by which a bank is known on its statements."""

# First four letters of a branch code, and the bank.
IFSC_BANKS = {
    "HDFC": "HDFC Bank", "SBIN": "State Bank of India", "ICIC": "ICICI Bank", "UTIB": "Axis Bank",
    "KKBK": "Kotak Mahindra Bank", "PUNB": "Punjab National Bank", "BARB": "Bank of Baroda", "BKID": "Bank of India",
    "MAHB": "Bank of Maharashtra", "CNRB": "Canara Bank", "UBIN": "Union Bank of India", "IDFB": "IDFC First Bank",
    "IBKL": "IDBI Bank", "YESB": "YES Bank", "RATN": "RBL Bank", "FDRL": "Federal Bank", "INDB": "IndusInd Bank",
    "UCBA": "UCO Bank", "IOBA": "Indian Overseas Bank", "IDIB": "Indian Bank", "AUBL": "AU Small Finance Bank",
    "BDBL": "Bandhan Bank", "ESFB": "Equitas Small Finance Bank", "UJVN": "Ujjivan Small Finance Bank",
    "JSFB": "Jana Small Finance Bank", "DCBL": "DCB Bank", "KARB": "Karnataka Bank", "SIBL": "South Indian Bank",
    "CIUB": "City Union Bank", "TMBL": "Tamilnad Mercantile Bank", "LAVB": "Lakshmi Vilas Bank", "NNSB": "Nainital Bank",
    "JAKA": "J&K Bank", "PYTM": "Paytm Payments Bank", "AIRP": "Airtel Payments Bank", "FINO": "Fino Payments Bank",
    "IPPB": "India Post Payments Bank", "CBIN": "Central Bank of India", "PSIB": "Punjab and Sind Bank",
    "COSB": "Cosmos Co-operative Bank", "SRCB": "Saraswat Co-op Bank", "MCBL": "Mahanagar Co-operative Bank",
    "SCBL": "Standard Chartered Bank", "HSBC": "HSBC Bank", "CITI": "Citibank", "DEUT": "Deutsche Bank",
    "BNPA": "BNP Paribas", "RBIS": "Reserve Bank of India",
}

# Phrases of a letterhead in their order. Phrases with signs that normalised text doesn't have can't be met and are left out.
PHRASES = (
    ("HDFC Bank", ("hdfc bank", "hdfc bank ltd", "hdfc bank limited", "hdfcbank", "hdfcbk", "hdfcbank.com")),
    ("State Bank of India", ("state bank of india", "sbi bank", "sbi branch", "sbi.co.in", "onlinesbi.com", "state bank")),
    ("ICICI Bank", ("icici bank", "icici bank limited", "icicibank", "icicibank.com")),
    ("Axis Bank", ("axis bank", "axis bank ltd", "axis bank limited", "axisbank", "axisbank.com")),
    ("Kotak Mahindra Bank", ("kotak mahindra bank", "kotak mahindra", "kotakbank.com", "kotak bank", "kotak")),
    ("Punjab National Bank", ("punjab national bank", "pnb.co.in", "pnbindia.in", "pnb bank", "pnb bank limited")),
    ("Bank of Baroda", ("bank of baroda", "bankofbaroda.in", "bankofbaroda.com")),
    ("Central Bank of India", ("central bank of india", "centralbankofindia.co.in", "central bank")),
    ("Union Bank of India", ("union bank of india", "unionbankofindia.co.in", "union bank")),
    ("Indian Overseas Bank", ("indian overseas bank", "iob.in", "iob bank")),
    ("Indian Bank", ("indian bank", "indianbank.in")),
    ("Bank of India", ("bank of india", "bankofindia.co.in", "bank of india ltd")),
    ("Bank of Maharashtra", ("bank of maharashtra", "bankofmaharashtra.in")),
    ("Canara Bank", ("canara bank", "canarabank.in", "canarabank.com")),
    ("IDFC First Bank", ("idfc first bank", "idfcfirstbank.com", "idfc bank")),
    ("IDBI Bank", ("idbi bank", "idbi.com", "industrial development bank")),
    ("YES Bank", ("yes bank", "yes bank limited", "yesbank.in")),
    ("RBL Bank", ("rbl bank", "rblbank.com", "ratnakar bank")),
    ("Federal Bank", ("federal bank", "federalbank.co.in", "the federal bank")),
    ("IndusInd Bank", ("indusind bank", "indusind.com", "induslnd bank", "indus ind bank")),
    ("UCO Bank", ("uco bank", "ucobank.com", "united commercial bank")),
    ("AU Small Finance Bank", ("au small finance bank", "aubank.in", "au sfb", "au bank")),
    ("Bandhan Bank", ("bandhan bank", "bandhanbank.com")),
    ("Punjab and Sind Bank", ("punjab and sind bank", "psbindia.com")),
    ("South Indian Bank", ("south indian bank", "sib.co.in", "the south indian bank")),
    ("Karnataka Bank", ("karnataka bank", "karnatakabank.com")),
    ("City Union Bank", ("city union bank", "cityunionbank.com")),
    ("Tamilnad Mercantile Bank", ("tamilnad mercantile", "tmb bank", "tmbank.in")),
    ("Lakshmi Vilas Bank", ("lakshmi vilas bank", "lvbank.in")),
    ("Nainital Bank", ("nainital bank", "nainitalbank.co.in")),
    ("J&K Bank", ("jammu and kashmir bank", "jkbank.com")),
    ("DCB Bank", ("dcb bank", "dcbbank.in")),
    ("Equitas Small Finance Bank", ("equitas small finance", "equitas bank", "equitasbank.com")),
    ("Ujjivan Small Finance Bank", ("ujjivan small finance", "ujjivan bank")),
    ("Jana Small Finance Bank", ("jana small finance", "jana bank", "janabank.in")),
    ("Cosmos Co-operative Bank", ("cosmos co operative bank", "cosmos bank", "cosmosbank.com", "cosmos cooperative")),
    ("Saraswat Co-op Bank", ("saraswat co op", "saraswat bank", "saraswatbank.com", "saraswat cooperative", "saraswat", "scbl")),
    ("Mahanagar Co-operative Bank", ("mahanagar co operative bank", "mahanagar cooperative bank", "mahanagar co op", "mahanagar bank",
                                     "gs mahanagar", "mahanager co operative bank", "mahanager cooperative bank", "mahanager bank")),
    ("Paytm Payments Bank", ("paytm payments bank", "paytmbank.com", "paytm bank")),
    ("Airtel Payments Bank", ("airtel payments bank", "airtelbank.com", "airtel bank")),
    ("Fino Payments Bank", ("fino payments bank", "finobank.com")),
    ("India Post Payments Bank", ("india post payments bank", "ippb.gov.in")),
    ("HSBC Bank", ("hsbc bank", "hsbc india", "hsbc.co.in")),
    ("Standard Chartered Bank", ("standard chartered", "standardchartered.co.in")),
    ("Citibank", ("citibank", "citi bank", "citiindia.com")),
)
# Banks whose phrases also stand in other banks' names count less.
PHRASE_WEIGHTS = {"Indian Bank": 0.9, "Bank of India": 0.9}

# Short names in the order in which they are tried.
SHORT_NAMES = (
    ("SBI", "State Bank of India"), ("HDFC", "HDFC Bank"), ("ICICI", "ICICI Bank"), ("AXIS", "Axis Bank"), ("PNB", "Punjab National Bank"),
    ("BOB", "Bank of Baroda"), ("BOI", "Bank of India"), ("BOM", "Bank of Maharashtra"), ("IOB", "Indian Overseas Bank"),
    ("KOTAK", "Kotak Mahindra Bank"), ("IDFC", "IDFC First Bank"), ("IDBI", "IDBI Bank"), ("UCO", "UCO Bank"), ("CBI", "Central Bank of India"),
    ("RBL", "RBL Bank"), ("DCB", "DCB Bank"), ("TMB", "Tamilnad Mercantile Bank"), ("JKB", "J&K Bank"), ("SIB", "South Indian Bank"),
    ("KBL", "Karnataka Bank"), ("CUB", "City Union Bank"), ("MCBL", "Mahanagar Co-operative Bank"),
)

# Web addresses, in the order in which they are tried.
DOMAINS = (
    ("HDFC Bank", r"hdfcbank\.com|hdfc\.com"), ("State Bank of India", r"sbi\.co\.in|onlinesbi\.com"), ("ICICI Bank", r"icicibank\.com"),
    ("Axis Bank", r"axisbank\.com"), ("Kotak Mahindra Bank", r"kotakbank\.com"), ("Punjab National Bank", r"pnb\.co\.in|pnbindia\.in"),
    ("Bank of Baroda", r"bankofbaroda\.in"), ("Bank of India", r"bankofindia\.co\.in"), ("Canara Bank", r"canarabank\.in"),
    ("Union Bank of India", r"unionbankofindia\.co\.in"), ("IDFC First Bank", r"idfcfirstbank\.com"), ("YES Bank", r"yesbank\.in"),
    ("RBL Bank", r"rblbank\.com"), ("Federal Bank", r"federalbank\.co\.in"), ("IndusInd Bank", r"indusind\.com"),
    ("AU Small Finance Bank", r"aubank\.in"), ("Bandhan Bank", r"bandhanbank\.com"), ("Cosmos Co-operative Bank", r"cosmosbank\.com"),
    ("Saraswat Co-op Bank", r"saraswatbank\.com"), ("J&K Bank", r"jkbank\.com"),
)
