"""Column expressions on text of any script: folding, compacting, segmenting, shingling.

Folding keeps every character's place, so offsets in folded text are offsets in the text. Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are white space, and ranges of those that are dropped unseen (zero-width, controls, private use).
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
UNSEEN = (("\x00", "\x08"), ("\x0e", "\x1f"), ("\x7f", "\x84"), ("\x86", "\x9f"), ("\xad", "\xad"), ("\u034f", "\u034f"), ("\u180e", "\u180e"), ("\u200b", "\u200f"), ("\u2060", "\u2060"), ("\ue000", "\uf8ff"), ("\ufeff", "\ufeff"))
#: Signs that fold to the sign before the colon; the first two rows are not letters but are lower-cased to one.
SIGNS = {
    "i": "İ", "σ": "Σ",
    ",": "、︐︑", ".": "。・·‧…︒︙", "<": "〈《", ">": "〉》", "[": "「『【〔", "]": "」』】〕",
    '"': "“”„‟〝〞", "'": "‘’‛′", "-": "—–―‒‐‑─•", ":": "︓", ";": "︔", "!": "︕", "?": "︖",
}
#: Full-width forms stand this far behind their ASCII ones.
WIDE, FIRST_WIDE, LAST_WIDE = 0xFEE0, 0xFF01, 0xFF5E
#: Traditional characters that fold to the simplified one at the same place; more are a parameter of folded().
TRADITIONAL = "體國學說時後來對觀點關機係經濟業產義習實際與為眾區嚴黃兒孫傳傷億僅從偉獨變讓讀麗圖團場壞雲飛馬鳥魚龍門問間開閉聞陽陰電風車東長頁頭題類飯館網靜萬舉藝節葉處條號設語誤論議謝講許訴調談認識譯試課動務勝勞勢醫發盡監確禮種樣權歡歲殺氣漢滿燈營現當覺計訂訊訓詞詩話該請數據統證測術應構顯環境護態標準斷備檔規範評審歷製"
SIMPLIFIED = "体国学说时后来对观点关机系经济业产义习实际与为众区严黄儿孙传伤亿仅从伟独变让读丽图团场坏云飞马鸟鱼龙门问间开闭闻阳阴电风车东长页头题类饭馆网静万举艺节叶处条号设语误论议谢讲许诉调谈认识译试课动务胜劳势医发尽监确礼种样权欢岁杀气汉满灯营现当觉计订讯训词诗话该请数据统证测术应构显环境护态标准断备档规范评审历制"
_WIDE = {chr(c): chr(c - WIDE).lower() for c in range(FIRST_WIDE, LAST_WIDE + 1)}
FOLDS: dict[str, str] = {c: " " for c in BLANKS if c != " "} | {c: to for to, every in SIGNS.items() for c in every} | _WIDE | {t: s for t, s in zip(TRADITIONAL, SIMPLIFIED, strict=True) if t != s}
#: What is neither seen nor counted, and letters, digits and marks, as regex classes without brackets.
JUNK = "".join(f"\\x{{{ord(c):X}}}" for c in BLANKS) + "".join(f"\\x{{{ord(a):X}}}-\\x{{{ord(b):X}}}" for a, b in UNSEEN)
LETTERS = r"\p{L}\p{M}\p{N}"
HAN = r"\x{4E00}-\x{9FFF}"
BREAKS = r"[\n\r\x{B}\x{C}\x{2028}\x{2029}]"
#: Signs that end a sentence, signs that are drawn into the one before them, and what may follow a full stop.
ENDS, CLOSERS = "。！？；!?;…", "。！？；…!?;.\"'”’』」)）\\]］】*>"
AFTER_STOP = r"[ \t\n\r\x{B}" + CLOSERS + r"\p{Lu}\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FF65}“‘]"
SENTENCE_END = rf"(?:[{ENDS}]|(?<![.…])[.．](?![0-9０-９.…])(?=\z|{AFTER_STOP}))[{CLOSERS}]*"
#: A list mark before a sentence: a bullet, (1) or [1], 1. or 1, or 1), 1:, iv) or iv. — two of them at most.
PREFIX = r"^(?: *(?:[-*>#]|[(\[][0-9]{1,4}[)\]]|[0-9]{1,4}(?:[.,)](?![0-9])|[、:])|[i-z][a-z0-9]{0,2}(?:\)|\.(?= |\z)))){0,2}"
#: A character that no text holds.
MARK = "\ufdd0"
#: The shortest sentence that is compared, and the window and stride that longer ones are cut by.
LEAST, WINDOW, STRIDE = 12, 512, 448


def folded(text: Column, variants: Mapping[str, str] | None = None) -> Column:
    """Width, signs, blanks, script variants and case folded, character by character."""
    table = FOLDS | dict(variants or {})
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    whole = F.translate(text, "".join(table), "".join(table.values()))
    return F.lower(F.when(F.octet_length(text) == F.length(text), plain).otherwise(whole))


def seen(text: Column) -> Column:
    """Without blanks and unseen characters."""
    return F.regexp_replace(text, f"[{JUNK}]+", "")


def compact(text: Column) -> Column:
    """Folded, without blanks and unseen characters: what texts are compared by."""
    return seen(folded(text))


def valid_chars(text: Column) -> Column:
    return F.length(seen(text)).cast("long")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{JUNK}]+|[{JUNK}]+$", "")


def blank_trimmed(text: Column) -> Column:
    own = "".join(f"\\x{{{ord(c):X}}}" for c in BLANKS)
    return F.regexp_replace(text, f"^[{own}]+|[{own}]+$", "")


def lines(text: Column) -> Column:
    """The lines that are not blank, trimmed."""
    return F.filter(F.transform(F.split(text, BREAKS), blank_trimmed), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Stretches up to line breaks or sentence ends, trimmed, closing signs drawn in.

    A full stop ends one only before a blank, a closing sign, a capital, a Han sign or the end, and not beside digits or dots."""
    marked = F.regexp_replace(text, SENTENCE_END, f"$0{MARK}")
    return F.filter(F.transform(F.split(marked, f"{MARK}|{BREAKS}"), trimmed), lambda x: x != "")


def sentence_key(sentence: Column) -> Column:
    """A sentence as it is compared: folded, without list marks before it, compact."""
    return seen(F.regexp_replace(folded(sentence), PREFIX, ""))


def windows(key: Column, size: int = WINDOW, stride: int = STRIDE, least: int = LEAST) -> Column:
    """A key in windows of so many characters, each at least so long; a short key is one."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1)), F.lit(stride)), lambda i: F.substring(key, i, F.lit(size)))
    return F.filter(F.when(F.length(key) > size, cut).otherwise(F.array(key)), lambda x: F.length(x) >= least)


def words(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(f"[{LETTERS}]+"), F.lit(0))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def grams(key: Column, n: int = 3) -> Column:
    """Distinct runs of n characters. key: a column, not an expression."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - (n - 1), F.lit(1))), lambda i: F.substring(key, i, F.lit(n)))
    return F.when(F.length(key) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def bag(key: Column) -> Column:
    """The distinct characters, in order."""
    return F.array_sort(F.array_distinct(characters(key)))


def dice(a: Column, b: Column) -> Column:
    """Twice what two arrays of distinct values share over what they hold; 0 for empty ones."""
    both = F.size(a) + F.size(b)
    return F.when(both > 0, 2.0 * F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def signature(of: Column, slots: int = 16) -> Column:
    """Least hash of an array's values under each of so many salts; null for an empty one."""
    salted = lambda s: F.array_min(F.transform(of, lambda g: F.xxhash64(g, F.lit(s))))
    each = [salted(s) for s in range(slots)]
    return F.when(F.size(of) > 0, F.array(*each))


def agreement(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] == x["b"]))


def latin_share(key: Column) -> Column:
    """The share of a to z among the characters of a folded, compact text; null for an empty one."""
    return F.try_divide(F.length(F.regexp_replace(key, "[^a-z]", "")), F.length(key))


def han_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{HAN}]", "")).cast("long")


def shingles(tokens: Column, n: int) -> Column:
    """Distinct runs of n tokens. tokens: a column, not an expression, which would be evaluated for each run."""
    each = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))
