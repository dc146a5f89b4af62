"""Rule tables. Words and their order decide results, the first matching rule wins."""

from __future__ import annotations

DOC_TYPES = [
    ("form", ["application form", "نموذج طلب", "استماره", "نموذج تسجيل"]),
    ("id", ["passport", "emirates id", "national id", "identity card", "جواز", "هويه", "بطاقه", "اقامه"]),
    ("bank", ["bank statement", "account statement", "iban", "swift", "كشف حساب", "ايبان", "الرصيد الافتتاحي", "closing balance"]),
    ("certificate", ["certificate", "شهاده", "degree", "diploma", "اتم بنجاح", "دوره تدريبيه", "completion", "يشهد", "تشهد"]),
    ("receipt", ["receipt", "ايصال", "سند قبض", "payment received", "مدفوع", "استلمنا"]),
    ("contract", ["contract", "agreement", "عقد", "اتفاقيه", "lease", "ايجار", "nda", "tenancy", "ejari", "ايجاري"]),
    ("medical", ["medical", "hospital", "clinic", "doctor", "patient", "طبي", "مستشفي", "عياده", "مريض", "وصفه", "prescription", "lab report", "تقرير طبي"]),
    ("legal", ["court", "legal", "law", "محكمه", "قانون", "دعوي"]),
    ("invoice", ["invoice", "فاتوره", "bill", "amount due", "total", "ضريبه", "vat", "aed", "درهم", "ريال", "sar", "الاجمالي"]),
    ("news", ["news", "article", "مقال", "خبر", "اخبار", "كشفت", "اعلنت", "تقنيه"]),
]
LEGISLATION = [
    "قانون اتحادي", "مرسوم بقانون", "مرسوم اتحادي", "قرار مجلس الوزراء", "قرار وزاري", "قرار رئيس مجلس", "الجريده الرسميه", "لائحه تنفيذيه", "بقانون رقم", "قانون رقم", "مرسوم رقم",
    "federal law", "decree law", "federal decree", "cabinet resolution", "cabinet decision", "ministerial decision", "ministerial resolution", "official gazette", "executive regulation", "law no", "decree no", "resolution no", "decision no",
]
PARTIES = ["الطرف الاول", "الطرف الثاني", "المستاجر", "المؤجر", "employee", "employer", "tenant", "landlord", "first party", "second party", "the parties agree"]
LEGAL_SUBTYPES = [
    ("Federal Laws", ["قانون اتحادي", "federal law"]),
    ("Decree-Laws", ["مرسوم بقانون", "decree law", "federal decree", "مرسوم اتحادي"]),
    ("Cabinet Resolutions", ["قرار مجلس الوزراء", "cabinet resolution", "cabinet decision"]),
    ("Ministerial Decisions", ["قرار وزاري", "ministerial decision", "ministerial resolution"]),
    ("Official Gazette", ["الجريده الرسميه", "official gazette"]),
    ("Forms and Templates", ["application form", "template", "نموذج"]),
    ("Guidance and Consultation", ["guidance note", "guidance", "consultation paper", "consultation", "circular", "faq", "faqs", "تعميم", "دليل", "ارشادات"]),
    ("Annexes and Appendices", ["annex", "appendix", "schedule", "ملحق"]),
    ("Court Rulings", ["judgment", "ruling", "دعوي", "الحكم الصادر", "court of appeal", "court of first instance"]),
    ("Regulations and Rules", ["لائحه", "regulation", "regulations", "rules", "نظام", "قواعد", "court", "محكمه"]),
]
#: Words of a legal title that only the title, not the body, may be filed by.
LAW_TITLE = ["law", "قانون", "laws"]
PROVIDERS = [
    ("Utility", ["dewa", "ديوا", "addc", "sewa", "fewa", "كهرباء", "electricity", "الكهرباء", "مياه", "ماء", "water", "غاز", "gas", "هيئه كهرباء"]),
    ("Telecom", ["etisalat", "اتصالات", "du ", "virgin mobile", "e&", "stc", "mobily", "زين", "zain", "انترنت", "internet", "فايبر", "fiber", "جوال", "mobile plan"]),
    ("Rent", ["ايجار", "rent", "lease", "عقار", "إيجار", "ejari", "ايجاري", "tenancy"]),
    ("Government", ["حكوم", "رسوم", "مرور", "جوازات", "بلدي", "تأشيره", "visa fee", "government", "municipality", "salik", "سالك", "amer", "tas-heel", "تسهيل"]),
    ("Shopping", ["امازون", "amazon", "نون", "noon", "كارفور", "carrefour", "شرف", "sharaf", "متجر", "store", "shop"]),
]
CATEGORIES = {"invoice": "Bills", "receipt": "Receipts", "contract": "Contracts", "bank": "Bank", "id": "IDs and Personal", "medical": "Medical", "certificate": "Certificates", "legal": "Legal", "news": "Articles", "general": "Other"}
TYPE_CODES = {"invoice": "bill", "receipt": "receipt", "contract": "contract", "bank": "bank", "id": "id", "medical": "medical", "certificate": "certificate", "legal": "law", "news": "article", "general": "doc"}
#: Types whose company gets a folder of its own from this many documents on.
BUSINESS, COMPANY_FOLDER_FROM = ("invoice", "receipt", "bank", "contract"), 3
INTENTS = [
    ("invoice", ["فاتوره", "الفاتوره", "bill", "invoice", "كهرباء", "utility"]),
    ("contract", ["عقد", "ايجار", "contract", "lease", "rent"]),
    ("id", ["هويه", "جواز", "passport", "emirates id"]),
    ("receipt", ["ايصال", "receipt", "payment"]),
    ("bank", ["بنك", "bank", "iban", "statement"]),
    ("medical", ["طبي", "مستشفي", "medical", "hospital", "clinic"]),
]
ASKS_AMOUNT = ["كم", "قيمه", "مبلغ", "total", "amount", "price"]
ASKS_DATE = ["تاريخ", "متي", "date", "expiry", "انتهاء", "due"]
ASKS_LATEST = ["اخر", "احدث", "latest", "newest", "recent"]
SYNONYMS = {
    "فاتوره": ["invoice", "bill", "total", "amount", "aed", "درهم", "اجمالي", "مبلغ"],
    "الفاتوره": ["فاتوره", "invoice", "bill", "total", "amount", "aed", "درهم", "اجمالي", "مبلغ"],
    "قيمه": ["amount", "total", "مبلغ", "اجمالي", "aed", "درهم"],
    "المبلغ": ["amount", "total", "مبلغ", "اجمالي", "aed", "درهم"],
    "كم": ["amount", "total", "مبلغ", "اجمالي"],
    "عقد": ["contract", "agreement", "lease", "rent", "ايجار"],
    "هويه": ["identity", "passport", "emirates", "id", "expiry", "انتهاء"],
    "تاريخ": ["date", "expiry", "due", "تاريخ"],
}
#: Prefixes: of a keyword's accepted forms, stripped from a word before it is compared (the first that fits), stripped from a question's word (each that fits).
KEYWORD_FORMS = ["ال", "و", "بال", "لل"]
STRIPPED_ONCE = ["وال", "بال", "لل", "ال", "و", "ب", "ل"]
STRIPPED_EACH = ["ال", "و", "ب", "بال", "لل"]

ARABIC = "\\x{0600}-\\x{06FF}"
TASHKEEL = "[\\x{0610}-\\x{061A}\\x{064B}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06ED}]"
#: One character for another, then characters that become spaces.
LETTERS = ("إأآٱىؤئة", "اااايويه")
SPACES = "؟،؛ـ"
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫٬", "01234567890123456789.,")
CURRENCY = r"(?:AED|SAR|USD|EUR|GBP|QAR|KWD|BHD|OMR|EGP|JOD|\$|€|£|د\.إ|ر\.س|ر\.ق|د\.ك|د\.ب|ر\.ع|د\.ا|درهم|ريال|دينار|جنيه|دولار|يورو)"
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]{1,2})?"
#: A character that a line of symbols and digits, of any script, doesn't have.
WORDLY = r"[\p{L}\p{Nl}\p{No}]"
#: A law's numbered article, a line of a total, a line that names a law, signs of an amount and of a date in a text: fixed values.
ARTICLE = r"(?:الماد[ةه]|article)\s*\(?\s*\p{Nd}+\s*\)?"
TOTAL = r"(?:grand\s*total|total\s*(?:due|amount)?|الاجمالي|الإجمالي|المجموع|المبلغ\s*الاجمالي|المبلغ\s*المستحق|صافي)"
LAW_LINE = r"(?:law|decree|resolution|regulation|rules|قانون|مرسوم|قرار|لائح|نظام)"
AMOUNT_SIGN = r"(?:AED|د\.إ|درهم|total|amount|اجمالي|مبلغ|\p{Nd}+[,.]?\p{Nd}*)"
DATE_SIGN = r"20\p{Nd}{2}|\p{Nd}{1,2}[-/.]\p{Nd}{1,2}|expiry|due|انتهاء|تاريخ"
#: Characters that aren't odd in clean text, as the inside of a character class.
USUAL = "A-Za-z0-9" + ARABIC + "\\s.,:;!؟،؛()\\[\\]{}_/\\\\+\\-=٪%$€£¥@#&*'\"|<>"
#: The same characters one by one, without those of the Arabic block; Latin letters.
LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
USUAL_ASCII, USUAL_OTHERS = LATIN + "0123456789" + " \t\n\x0b\f\r" + ".,:;!()[]{}_/\\+-=%$&*'\"|<>@#", "\u061f\u060c\u061b\u066a€£¥"
DATES = [
    r"\b(20[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2})\b",
    r"\b([0-9]{1,2}[-/.][0-9]{1,2}[-/.]20[0-9]{2})\b",
    r"\b([0-9]{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+20[0-9]{2})\b",
    r"\b(14[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2})\b",
]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
EXTENSIONS = {
    "pdf": ["pdf"], "image": ["png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff"], "text": ["txt", "md", "csv", "json"], "rtf": ["rtf"],
    "word": ["docx", "docm", "dotx"], "excel": ["xlsx", "xlsm", "xltx"], "slides": ["pptx", "pptm", "ppsx"], "legacy": ["doc", "xls", "ppt"],
}
# ideas of size: tokens of a chunk and of its overlap, candidates of each index, results at most, dimensions of a hashed vector
CHUNK_TOKENS, OVERLAP_TOKENS, CANDIDATES, RESULTS, DIMENSIONS = 700, 90, 60, 20, 384
