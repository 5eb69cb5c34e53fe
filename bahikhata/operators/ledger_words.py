"""Keyword tables of the classifier, the GST analysis and the chart-of-accounts groups."""

from __future__ import annotations

# The keyword ladder, first hit wins. (ledger head, voucher type, default vendor, keywords, vendors by keyword).
LADDER = (
    ("Cash", "Contra", "Self", ("ATM WDL", "ATM-WDL", "ATM CASH", "ATM/", "CASH WITHDRAWAL", "CASH WDL", "CASH DEP"), ()),
    ("Interest Income", "Receipt", "*bank", (
        "INTEREST CREDITED", "INT.CR", "INTEREST CR", "INT CR", "INTEREST CREDIT", "FD INTEREST", "FD MATURITY", "RD MATURITY", "INTEREST ON FD",
    ), ()),
    ("Bank Charges", "Payment", "*bank", (
        "INTEREST CHARGED", "INT.DEB", "INTEREST DR", "INTEREST DEBIT", "BANK CHARGES", "SERVICE CHARGE", "SMS CHARGES", "ANNUAL FEE", "LEDGER FOLIO",
        "CHGS RECOVERED", "MIN BAL CHGS", "PROCESSING FEE", "ACCOUNT MAINTENANCE", "DEBIT CARD FEE", "CREDIT CARD FEE", "LOCKER CHARGES",
    ), ()),
    ("GST Payable", "Payment", "Government (GST)", ("GST PAYMENT", "GST PMT", "IGST PMT", "CGST PMT", "SGST PMT", "NSDL GST", "GST CHALLAN"), ()),
    ("Income Tax Payable", "Payment", "Income Tax Dept", (
        "INCOME TAX", "ADVANCE TAX", "SELF ASSESSMENT TAX", "TDS PAYMENT", "TDS PMT", "CHALLAN 280", "ITNS 280", "TRACES TDS", "TAX DEDUCTED",
    ), ()),
    ("Salaries", "Payment", "Staff", ("SALARY", "SAL/", "SAL-", "SALARY CREDIT", "PAYROLL", "WAGES"), ()),
    ("Rent", "Payment", "Landlord", ("RENT", "RENTAL", "LEASE PAYMENT", "RENT PAYMENT"), ()),
    ("Fuel Expense", "Payment", "Fuel Station", (
        "PETROL", "DIESEL", "FUEL", "BPCL", "HPCL", "IOCL", "INDIAN OIL", "BHARAT PETRO", "SHELL INDIA", "HP PUMP", "RELIANCE PETRO",
    ), ()),
    ("Telephone Expense", "Payment", "Telecom", (
        "AIRTEL", "VODAFONE", "VODAFON", "VI/", "JIO", "BSNL", "MTNL", "TATASKY", "DISH TV", "BROADBAND", "JIOFIBER", "TATA SKY",
    ), (("AIRTEL", "Airtel"), ("JIO", "Jio"), ("BSNL", "BSNL"), ("VODAFONE", "Vodafone"), ("VI/", "Vodafone"))),
    ("Electricity Charges", "Payment", "Electricity Board", (
        "MSEDCL", "BESCOM", "BSES", "TNEB", "WBSEDCL", "TORRENT POWER", "TPDDL", "TANGEDCO", "ELECTRICITY", "ELECTRIC BILL", "POWER BILL",
    ), ()),
    ("Insurance Premium", "Payment", "Insurance Co", (
        "LIC PREMIUM", "LIC/", "HDFC LIFE", "MAX LIFE", "ICICI PRU", "STAR HEALTH", "NIVA BUPA", "NEW INDIA ASSURANCE", "UNITED INDIA", "ORIENTAL INS",
        "INSURANCE PREMIUM", "INS PREM",
    ), ()),
    ("Food Expense", "Payment", "Food Delivery", ("SWIGGY", "ZOMATO", "UBER EATS", "DUNZO"), (("SWIGGY", "Swiggy"), ("ZOMATO", "Zomato"))),
    ("Food Expense", "Payment", "Food / Dining", (
        "BREAD", "BAKERY", "BISCUIT", "CANTEEN", "TIFFIN", "LUNCH", "DINNER", "BREAKFAST", "SNACKS", "CHAI", "TEA STALL", "FOOD", "RESTAURANT", "HOTEL DINING",
        "MESS", "DHABA", "CAFE", "HALDIRAM", "DOMINOS", "PIZZA HUT", "MCDONALDS", "KFC", "SUBWAY", "BURGER KING", "STARBUCKS", "CHAAYOS", "COFFEE", "SHEVPURI",
        "SHEV PURI",
    ), ()),
    ("Grocery Expense", "Payment", "Grocery / Kirana", (
        "BIGBASKET", "BIG BAZAAR", "DMART", "D-MART", "RELIANCE FRESH", "RELIANCE SMART", "MORE MEGASTORE", "STAR BAZAAR", "JIOMART", "GROFERS", "BLINKIT",
        "ZEPTO", "INSTAMART", "MILKBASKET", "GROCERY", "KIRANA", "SABZI", "VEGETABLE", "FRUITS", "DAIRY", "MILK", "PANEER", "GHEE", "OIL", "RICE", "WHEAT",
        "ATTA", "PULSES", "MASALA", "SPICES", "PROVISION", "BHAJI", "PAPAD", "DAHI",
    ), ()),
    ("Personal Care Expense", "Payment", "Personal Care", ("PARLOUR", "PARLOR", "SALON", "HAIRCOLOUR", "HAIR COLOUR", "HAIRCUT", "BEAUTY"), ()),
    ("Courier & Postage Expense", "Payment", "Courier Service", (
        "COURIER", "SPEEDPOST", "SPEED POST", "DTDC", "BLUEDART", "BLUE DART", "FEDEX", "DELHIVERY", "POSTAGE",
    ), ()),
    ("Printing & Stationery Expense", "Payment", "Stationery Shop", ("PHOTOCOPY", "XEROX", "STATIONERY", "PRINTOUT", "PRINTING"), ()),
    ("Medical Expense", "Payment", "Medical", ("MEDPLUS", "APOLLO PHARMACY", "NETMEDS", "TATA 1MG", "1MG", "PHARMEASY", "HEALTHKART", "PRACTO", "LYBRATE"), ()),
    ("Office Expense", "Payment", "Online Shopping", (
        "AMAZON", "FLIPKART", "MYNTRA", "MEESHO", "SNAPDEAL", "NYKAA", "AJIO", "SHOPCLUES",
    ), (("AMAZON", "Amazon"), ("FLIPKART", "Flipkart"), ("MYNTRA", "Myntra"), ("MEESHO", "Meesho"))),
    ("Software Expense", "Payment", "Software", (
        "GOOGLE", "MICROSOFT", "ZOOM", "DROPBOX", "CANVA", "ADOBE", "SLACK", "NOTION", "GODADDY", "BLUEHOST", "HOSTINGER", "GSUITE", "WORKSPACE", "OFFICE 365",
        "AWS", "AZURE", "NETLIFY", "VERCEL",
    ), (("GOOGLE", "Google"), ("MICROSOFT", "Microsoft"), ("ZOOM", "Zoom"), ("AWS", "Amazon AWS"))),
    ("Travelling Expense", "Payment", "Transport", ("UBER", "OLA CAB", "OLA/", "RAPIDO", "MERU"), (("UBER", "Uber"), ("OLA", "Ola"))),
    ("Travelling Expense", "Payment", "Travel", (
        "IRCTC", "RAILWAY", "INDIGO", "AIR INDIA", "MAKEMYTRIP", "YATRA", "CLEARTRIP", "GOIBIBO", "VISTARA", "SPICEJET", "AKASA",
    ), ()),
    ("Professional Fees", "Payment", "", ("PROFESSIONAL FEES", "CONSULTING", "CA FEES", "AUDIT FEES", "LEGAL FEES", "ADVOCATE FEE", "CHARTERED ACCOUNTANT"), ()),
    ("Loan Account", "Payment", "Bank/NBFC", (
        "EMI", "LOAN EMI", "HOME LOAN EMI", "CAR LOAN", "PERSONAL LOAN", "BAJAJ FINSERV", "HDFC LOAN", "ICICI LOAN", "SBI LOAN",
    ), ()),
    ("Investments", "Payment", "Investment", (
        "MUTUAL FUND", "SIP", "ZERODHA", "GROWW", "UPSTOX", "ANGEL BROKING", "ICICIDIRECT", "HDFC SEC", "KOTAK SEC", "MOTILAL", "NUVAMA", "PAYTM MONEY",
    ), ()),
    ("Dividend Income", "Receipt", "Investment", ("DIVIDEND", "DIVIDEND CREDIT"), ()),
    ("Advertisement Expense", "Payment", "Advertisement", ("GOOGLE ADS", "FACEBOOK ADS", "META ADS", "INSTAGRAM ADS", "YOUTUBE ADS", "DIGITAL MARKETING"), ()),
)
# Payment rails, for rows that no keyword names.
RAILS = ("NEFT", "INFT", "RTGS", "IMPS", "UPI", "NACH", "ECS", "ACH", "BBPS")

# GST by vendor group, first hit wins. (rate, type, expense ledger, keywords).
GST_VENDORS = (
    (18.0, "CGST+SGST", "Telephone Expense", ("AIRTEL", "JIO", "BSNL", "VODAFONE", "VI ", "IDEA", "TATA TELE")),
    (18.0, "CGST+SGST", "Internet Charges", ("INTERNET", "BROADBAND", "FIBER", "EXCITEL", "HATHWAY", "ACT FIBER", "RAILWIRE")),
    (18.0, "CGST+SGST", "Software Expense", (
        "MICROSOFT", "GOOGLE", "AWS", "AMAZON WEB", "AZURE", "ZOHO", "SALESFORCE", "FRESHDESK", "HUBSPOT", "QUICKBOOKS", "NOTION", "SLACK", "ZOOM", "WEBEX",
    )),
    (5.0, "CGST+SGST", "Electricity Charges", (
        "MSEDCL", "BESCOM", "TNEB", "KSEB", "CESC", "WBSEDCL", "TORRENT POWER", "ADANI ELECTRICITY", "ELECTRICITY BOARD", "POWER SUPPLY",
    )),
    (18.0, "CGST+SGST", "Insurance Premium", (
        "INSURANCE", "LIC", "SBI LIFE", "HDFC LIFE", "ICICI PRU", "MAX LIFE", "BAJAJ ALLIANZ", "STAR HEALTH", "MEDICLAIM", "POLICY",
    )),
    (18.0, "CGST+SGST", "Professional Fees", ("CONSULTANT", "AUDIT", "LEGAL", "ADVOCATE", "CHARTERED", "CA FIRM", "LAWYER")),
    (18.0, "CGST+SGST", "Rent", ("RENT", "OFFICE RENT", "SHOP RENT", "RENTAL", "LANDLORD")),
    (5.0, "CGST+SGST", "Courier & Freight", ("COURIER", "DTDC", "BLUEDART", "DELHIVERY", "AMAZON SHIP", "LOGISTIC", "TRANSPORT", "FREIGHT")),
    (5.0, "CGST+SGST", "Food Expense", ("SWIGGY", "ZOMATO", "RESTAURANT", "HOTEL", "CAFE", "DHABA", "BARBEQUE")),
    (0.0, "EXEMPT", "Fuel Expense", ("PETROL", "DIESEL", "BPCL", "HPCL", "INDIAN OIL", "HP PETRO", "FUEL PUMP")),
    (5.0, "CGST+SGST", "Travelling Expense", ("UBER", "OLA", "RAPIDO", "MERU", "TAXISURE")),
    (18.0, "CGST+SGST", "Advertisement Expense", ("FACEBOOK ADS", "GOOGLE ADS", "META ADS", "INSTAGRAM ADS", "LINKEDIN ADS")),
)
GST_RATES = (28, 18, 12, 5)

# Chart-of-accounts groups by words of a ledger head. (group, weight, keywords).
GROUP_WORDS = (
    ("Sales Accounts", 10, ("sales", "sale", "revenue", "turnover", "gross receipt")),
    ("Direct Income", 10, ("service income", "service revenue", "consulting income", "fees income", "income from service")),
    ("Indirect Income", 10, ("commission income", "brokerage income", "agency income", "referral income")),
    ("Indirect Income", 10, ("interest income", "interest received", "bank interest", "fd interest", "interest on loan")),
    ("Indirect Income", 10, ("rental income", "rent income", "lease income", "sublease income")),
    ("Indirect Income", 10, ("dividend income", "dividend received")),
    ("Indirect Income", 8, ("misc income", "miscellaneous income", "other income", "sundry income")),
    ("Indirect Income", 8, ("grant income", "subsidy income", "export incentive")),
    ("Purchase Accounts", 10, ("purchase", "purchases", "raw material", "stock purchase", "goods purchase", "import")),
    ("Indirect Expenses", 10, ("salary", "salaries", "wage", "wages", "payroll", "stipend", "remuneration")),
    ("Indirect Expenses", 10, ("rent", "office rent", "shop rent", "godown rent", "rental expense", "lease expense")),
    ("Indirect Expenses", 9, ("telephone", "mobile", "phone bill", "landline", "sim")),
    ("Indirect Expenses", 9, ("internet", "broadband", "data plan", "wifi", "leased line", "connectivity")),
    ("Indirect Expenses", 9, ("electricity", "power bill", "utility bill", "msedcl", "bescom", "tneb")),
    ("Indirect Expenses", 9, (
        "bank charge", "bank fee", "bank commission", "processing fee", "annual fee", "service charge", "maintenance charge", "sms charge", "ecs charge",
    )),
    ("Indirect Expenses", 9, ("professional fee", "consultancy", "audit fee", "legal fee", "advocate fee", "ca fee", "cs fee", "notary", "registration fee")),
    ("Indirect Expenses", 9, ("insurance", "premium", "mediclaim", "policy", "life insurance", "vehicle insurance")),
    ("Indirect Expenses", 9, ("travel", "travelling", "tour", "conveyance", "cab", "taxi", "ola", "uber", "irctc", "airline", "train ticket", "flight")),
    ("Indirect Expenses", 9, ("advertisement", "advertising", "marketing", "promotion", "digital ad", "facebook ad", "google ad", "hoarding", "banner")),
    ("Indirect Expenses", 8, ("printing", "stationery", "office supply", "paper", "ink", "toner")),
    ("Indirect Expenses", 8, ("repair", "maintenance", "amc", "annual maintenance", "service contract", "housekeeping", "pest control")),
    ("Indirect Expenses", 8, ("fuel", "petrol", "diesel", "cng", "hp fuel", "bpcl", "hpcl")),
    ("Indirect Expenses", 8, ("food", "meal", "canteen", "lunch", "dinner", "tea", "refreshment", "snack")),
    ("Indirect Expenses", 8, ("medical", "medicine", "pharmacy", "hospital", "doctor", "clinic", "health")),
    ("Indirect Expenses", 7, ("grocery", "vegetable", "kirana", "supermarket", "bigbasket", "blinkit")),
    ("Indirect Expenses", 8, ("software", "subscription", "saas", "app", "license", "domain", "hosting", "aws", "azure", "google cloud", "github", "notion")),
    ("Indirect Expenses", 8, ("vehicle", "car expense", "two wheeler", "bike service", "vehicle maintenance")),
    ("Indirect Expenses", 8, ("courier", "freight", "logistics", "shipping", "delivery charge", "cargo")),
    ("Indirect Expenses", 7, ("staff welfare", "employee welfare", "birthday", "outing", "team lunch")),
    ("Indirect Expenses", 7, ("security", "guard", "watchman", "cctv", "security service")),
    ("Indirect Expenses", 7, ("cleaning", "sweeping", "housekeeping", "janitorial")),
    ("Indirect Expenses", 6, ("miscellaneous", "misc expense", "sundry expense", "petty", "petty cash")),
    ("Indirect Expenses", 7, ("office expense", "office cost", "admin expense", "administrative")),
    ("Direct Expenses", 10, ("production", "manufacturing", "factory", "job work", "conversion", "packing material")),
    ("Direct Expenses", 9, ("labour", "direct labour", "contract labour", "labour charge")),
    ("Duties & Taxes", 10, ("gst payable", "cgst payable", "sgst payable", "igst payable", "gst liability")),
    ("Duties & Taxes", 10, ("tds payable", "tds deducted", "tax deducted", "income tax payable", "advance tax")),
    ("Duties & Taxes", 9, ("professional tax", "pt payable", "esic", "provident fund", "pf payable", "epf")),
    ("Duties & Taxes", 9, ("customs duty", "import duty", "excise", "cess")),
    ("Sundry Creditors", 10, ("creditor", "supplier", "vendor payable", "accounts payable", "trade payable")),
    ("Sundry Debtors", 10, ("debtor", "customer receivable", "accounts receivable", "trade receivable")),
    ("Cash-in-Hand", 10, ("cash", "petty cash", "cash in hand")),
    ("Bank Accounts", 8, ("bank account", "current account", "savings account", "hdfc", "icici", "sbi", "axis")),
    ("Fixed Assets", 9, ("computer", "laptop", "desktop", "server", "printer", "scanner", "hardware")),
    ("Fixed Assets", 9, ("furniture", "office furniture", "chair", "table", "cabinet", "rack")),
    ("Fixed Assets", 9, ("machinery", "equipment", "plant", "motor", "generator")),
    ("Fixed Assets", 9, ("vehicle", "car", "bike", "truck", "van", "bus", "four wheeler")),
    ("Fixed Assets", 9, ("building", "land", "property", "office building", "warehouse")),
    ("Fixed Assets", 8, ("intangible", "patent", "trademark", "copyright", "goodwill")),
    ("Investments", 9, ("investment", "mutual fund", "share", "equity", "bonds", "debenture", "nsc", "ppf", "fd")),
    ("Loans & Advances (Asset)", 9, ("advance", "loan given", "loan to staff", "advance to employee", "security deposit", "refundable deposit")),
    ("Deposits (Asset)", 8, ("deposit", "security deposit", "earnest money", "margin money")),
    ("Loans (Liability)", 9, ("loan", "term loan", "working capital loan", "overdraft", "od limit", "cc limit", "borrowing", "credit facility", "emi", "mortgage")),
    ("Capital Account", 10, ("capital", "owner capital", "proprietor capital", "partner capital", "share capital")),
    ("Reserves & Surplus", 10, ("reserve", "surplus", "retained earning", "profit reserve", "general reserve")),
)


def keyword_rows() -> list[tuple[str, int, str, int]]:
    """(keyword, weight with its length bonus, group, order of the group's first appearance)."""
    order = list(dict.fromkeys(g for g, _, _ in GROUP_WORDS))
    return [(k, w + len(k) // 5, g, order.index(g)) for g, w, words in GROUP_WORDS for k in words]
