"""Regular expressions in Java's dialect, with the character classes that Python's ``re`` and ``str`` use.

``\\s`` and ``\\S`` of Java know ASCII only; the classes here name what Unicode-aware splitting and stripping take
for blank.
"""

#: What str.split and str.strip take for blank.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same as single characters.
WS_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
BLANKS = f"[{WS}]+"
TOKEN = f"[^{WS}]+"
ENDS = f"^[{WS}]+|[{WS}]+$"
#: A run of blanks with a line end in it.
LINE_BREAK = f"[{WS}]*[\\n\\r\\x1c-\\x1e\\x85\\u2028\\u2029][{WS}]*"
INNER_BLANKS = r"[ \t\f\x0B]+"
TAG = "<[^>]+>"
URL = f"(?i)https?://[^{WS}]+|www\\.[^{WS}]+"
ENTITY = "&[a-z]+;"
SENTENCE = r"[^.!?…]+(?:[.!?…]+|$)"
SENTENCE_GAP = f"(?<=[.!?。！？])[{WS}]+"

#: Source names that crawling glued to the next word.
GLUED_PREFIXES = ("Theo", "Ảnh", "Video")
GLUED_NUMBER_PREFIX = "Tin sao Việt"
#: The letters after which, and the words before which, crawling lost a blank.
GLUED_AFTER = "a-zàáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵđ0-9"
GLUED_WORDS = [
    w.replace("_", " ")
    for w in (
        "được đã đang đến để đây đó đồng đấu là làm lại lên lúc và với về vào vẫn của các cho khi như này năm ngày người "
        "trong trên trúng tại từ sau theo thanh_toán giao_dịch làng_sao dữ_liệu gout opera"
    ).split()
]

PREFIX = rf"(?U)\b({'|'.join(GLUED_PREFIXES)})(?=[A-ZÀ-ỸĐ])"
NUMBER_PREFIX = rf"(?U)\b{GLUED_NUMBER_PREFIX}(?=\p{{Nd}})"
#: The words as a pattern, those with one first letter together, which spares most comparisons.
_FIRST = sorted({w[0] for w in GLUED_WORDS})
ANY_GLUED = "|".join(f"{a}(?:{'|'.join(w[1:] for w in GLUED_WORDS if w[0] == a)})" for a in _FIRST)
#: Inserting at every place from which only listed words follow up to a word end equals inserting until nothing changes.
GLUED = rf"(?iuU)(?<=[{GLUED_AFTER}])(?=(?:{ANY_GLUED})+\b)"
