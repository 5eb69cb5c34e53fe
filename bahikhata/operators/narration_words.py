"""Word tables of narration cleaning, ledger names and recognised text."""

from __future__ import annotations

# Known vendors by the words that name them, first hit wins.
VENDORS = (
    ("AMAZON SELLER", "Amazon Seller"), ("AMAZON", "Amazon"), ("FLIPKART", "Flipkart"), ("SWIGGY INSTAMART", "Swiggy"), ("SWIGGY", "Swiggy"),
    ("ZOMATO", "Zomato"), ("AIRTEL", "Airtel"), ("RELIANCE JIO", "Reliance Jio"), ("JIO", "Reliance Jio"), ("VODAFONE", "Vodafone"), ("BSNL", "BSNL"),
    ("MSEDCL", "MSEDCL"), ("BESCOM", "BESCOM"), ("LIC", "LIC of India"), ("ICICI PRU", "ICICI Prudential"), ("HDFC LIFE", "HDFC Life"),
    ("MAX LIFE", "Max Life Insurance"), ("STAR HEALTH", "Star Health Insurance"), ("FACEBOOK", "Meta (Facebook)"), ("GOOGLE", "Google"),
    ("NETFLIX", "Netflix"), ("HOTSTAR", "Disney+ Hotstar"), ("SPOTIFY", "Spotify"), ("MICROSOFT", "Microsoft"), ("APPLE", "Apple"), ("UBER", "Uber"),
    ("OLA", "Ola"), ("RAPIDO", "Rapido"), ("IRCTC", "IRCTC"), ("MAKEMYTRIP", "MakeMyTrip"), ("GOIBIBO", "Goibibo"), ("MYNTRA", "Myntra"),
    ("NYKAA", "Nykaa"), ("BIGBASKET", "BigBasket"), ("BLINKIT", "Blinkit"), ("ZEPTO", "Zepto"), ("PAYTM", "Paytm"), ("PHONEPE", "PhonePe"),
    ("RAZORPAY", "Razorpay"), ("CASHFREE", "Cashfree"), ("GPAY", "Google Pay"), ("GPY", "Google Pay"), ("BPCL", "BPCL"), ("HPCL", "HPCL"),
    ("INDIAN OIL", "Indian Oil"), ("TATA", "Tata"), ("ELECTRICITY", "Electricity Board"), ("DUNZO", "Dunzo"), ("JUSPAY", "Juspay"),
)
# Words of a narration that say nothing of the party.
JUNK = tuple("""NEFT RTGS IMPS UPI NACH ACH ECS ATM POS DD CHQ CLG CR DR CREDIT DEBIT INWARD OUTWARD TRF TRANSFER BY TO FROM VIA FOR PER OF AT ON IN AND
THE REF UTR TXN NO NUM ID TRNF PAYMENT PAID PAY RECEIVED RECV RCV SENT SEND ONLINE NET BANKING INB MB MOB BANK BRANCH IFSC MICR SWIFT DEP DEPOSIT WDL
WITHDRAWAL WITH INT INTEREST CLEARING AMT AMOUNT BAL BALANCE CHARGES CHRGS CHGS LEVY FEE FEES SB CA OD FD RD SAVINGS CURRENT AC ACCT ACCOUNT INR RS P2P
P2M P2B P2A""".split())
# banks' short names, which are no parties.
BANK_TOKENS = tuple("""HDFC HDFCBANK ICICI ICICIB SBI SBIN AXIS AXISB KOTAK PNB BOI BOB IOB CANARA UNION IDBI YES RBL FEDERAL INDUSIND UCO PAYTM PHONEPE
GPAY CRED""".split())
# Words that stay in lower case inside a name.
SMALL_WORDS = ("of", "in", "at", "for", "and", "or", "by", "to", "the", "a", "an")
# What a cleaned narration begins with, by payment type.
PREFIXES = (
    ("UPI", "UPI - "), ("NEFT", "NEFT - "), ("RTGS", "RTGS - "), ("IMPS", "IMPS - "), ("NACH", "NACH/ACH - "), ("ATM", "ATM Withdrawal"), ("POS", "Card Payment - "),
    ("CHEQUE", "Cheque - "), ("CASH", "Cash"), ("INTEREST", "Interest"), ("CHARGES", "Bank Charges"), ("TRANSFER", "Transfer - "), ("SALARY", "Salary - "),
    ("EMI", "EMI - "), ("DD", "Demand Draft - "), ("SWIFT", "SWIFT Transfer - "),
)
# Words that end a ledger's name without being part of it, and words of businesses.
NAME_ENDS = tuple("""LTD LIMITED PVT PRIVATE INC CORP CORPORATION LLC LLP INDIA INDIAN SERVICES SERVICE SOLUTIONS SOLUTION TECHNOLOGIES TECHNOLOGY TECH
SYSTEMS SYSTEM ENTERPRISES ENTERPRISE GROUP HOLDINGS HOLDING PAY PAYMENT PAYMENTS SELLER SELLERS MARKETPLACE RETAIL STORE SHOP ONLINE DIGITAL MOBILE
INSTAMART EXPRESS NOW QUICK""".split())
BUSINESS = tuple("""TRADERS TRADING TRADE INDUSTRIES INDUSTRY MANUFACTURING DISTRIBUTORS DISTRIBUTOR EXPORTERS EXPORTER IMPORTERS IMPORTER AGENCY AGENCIES
CONTRACTORS CONTRACTOR DEVELOPERS DEVELOPER BUILDERS BUILDER CONSTRUCTIONS CONSTRUCTION ASSOCIATES ASSOCIATE PARTNERS PARTNER BROTHERS BROS CO COMPANY
WORKS CONSULTANTS CONSULTANCY MART CENTRE CENTER HOUSE DEALERS DEALER SUPPLIERS SUPPLIER HOSPITAL CLINIC SCHOOL COLLEGE INSTITUTE FOUNDATION TRUST
BANK""".split())
# Words of heads that are categories and not parties.
CATEGORIES = ("expense", "income", "payable", "receivable", "charges", "fee", "salary", "rent", "interest", "purchase", "tax", "cash", "contra", "provision", "allowance",
              "sundry debtors", "sundry creditors")
# Terms of bank statements that recognised text is corrected to.
BANK_TERMS = tuple("""NEFT RTGS IMPS UPI NACH ACH ECS BBPS CREDIT DEBIT TRANSFER BALANCE INTEREST CHARGES DEPOSIT WITHDRAWAL CHEQUE CLEARING NARRATION
SALARY PAYMENT RECEIPT VOUCHER AIRTEL BSNL RELIANCE VODAFONE MSEDCL BESCOM ELECTRICITY AMAZON FLIPKART SWIGGY ZOMATO HDFC ICICI AXIS KOTAK SBI REFUND
REVERSAL BOUNCE RETURN SUSPENSE CONTRA JOURNAL""".split())
