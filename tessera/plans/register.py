"""The register of queries, and the SQL of what many of them share."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import text as T
from tessera.operators.sizes import spread

#: Tables of long texts.
LONG = ("documents", "pages")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, *tables: str) -> Callable:
    """Registers a function of the named tables. Without SQL, tests hold it against another form."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*(spread(df) if t in LONG else df for t in tables for df in [spark.read.parquet(f"{sf_dir}/{t}.parquet")]))
        if sql:
            SQL[name] = sql
        return f

    return register



# The SQL states on its own what text.py states for Spark; only the table of script variants, a parameter there, is shared.
_BLANK = [chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]
_WIDE = [chr(c) for c in range(0xFF01, 0xFF5F)]
_PAIRS = dict.fromkeys(_BLANK, " ") | {c: unicodedata.normalize("NFKC", c).lower() for c in _WIDE}
for _every, _one in (("、︐︑", ","), ("。・·‧…︒︙", "."), ("〈《", "<"), ("〉》", ">"), ("「『【〔", "["), ("」』】〕", "]"), ("“”„‟〝〞", '"'), ("‘’‛′", "'"), ("—–―‒‐‑─•", "-"), ("︓", ":"), ("︔", ";"), ("︕", "!"), ("︖", "?"), ("İ", "i"), ("Σ", "σ")):
    _PAIRS |= dict.fromkeys(_every, _one)
_PAIRS |= dict(zip(T.TRADITIONAL, T.SIMPLIFIED, strict=True))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FOLD = f"lower(translate(text, {_quoted(''.join(_PAIRS))}, {_quoted(''.join(_PAIRS.values()))}))"
_JUNK = r"\x{0}-\x{20}\x{7F}-\x{A0}\x{AD}\x{34F}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{E000}-\x{F8FF}\x{FEFF}"
COMPACT = f"regexp_replace({FOLD}, '[{_JUNK}]', '', 'g')"
SEEN = f"length(regexp_replace(text, '[{_JUNK}]', '', 'g'))"
# a full stop that ends a sentence gets a mark behind it; the second pass finds those whose neighbour the first one took
_STOP = r"(^|[^.…])([.．])(\z|[ \t\n\r\x{B}。！？；…!?;" + "\"''”’』」)）\\]］】*>" + r"\p{Lu}\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF01}-\x{FF0D}\x{FF0F}\x{FF1A}-\x{FF65}\x{FF00}“‘])"
_MARKED = f"regexp_replace(regexp_replace(text, '{_STOP}', '\\1\\2\ufdd1\\3', 'g'), '{_STOP}', '\\1\\2\ufdd1\\3', 'g')"
_CUT = f"regexp_replace({_MARKED}, '(?:[。！？；!?;…]|[.．]\ufdd1)[。！？；…!?;.\"''”’』」)）\\]］】*>\ufdd1]*', '\\0\ufdd0', 'g')"
SENTENCES = f"list_filter(list_transform(regexp_split_to_array(replace({_CUT}, '\ufdd1', ''), '[\ufdd0\\n\\r\\x{{B}}\\x{{C}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x, '^[{_JUNK}]+|[{_JUNK}]+$', '', 'g')), lambda x: x <> '')"
WORDS = f"regexp_extract_all({FOLD}, '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"
BLANKS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
LINES = f"list_filter(list_transform(regexp_split_to_array(text, '[\\n\\r\\x{{B}}\\x{{C}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x, '^{_SPACE}|{_SPACE}$', '', 'g')), lambda x: x <> '')"
_ROUND = r"^ *(?:[-*>#]|[(\[][0-9]{1,4}[)\]]|[0-9]{1,4}(?:[、:]|[.,)]([^0-9]|\z))|[i-z][a-z0-9]{0,2}(?:\)|\.( |\z)))"
KEY = f"regexp_replace(regexp_replace(regexp_replace({FOLD}, '{_ROUND}', '\\1\\2'), '{_ROUND}', '\\1\\2'), '[{_JUNK}]', '', 'g')"
FRAGMENTS = f"""select KEY_, fragment, length(fragment) size from (select KEY_, unnest(case when length(k) > 512 then list_transform(range(1, length(k) + 1, 448), lambda i: substr(k, i::bigint, 512)) else [k] end) fragment from (select KEY_, {KEY} k from (select KEY_, unnest({SENTENCES}) as text from TABLE_))) where length(fragment) >= 12"""
#: doc_id, i, text: the sentences of each document in order.
ORDERED = f"select doc_id, unnest(l) as text, unnest(range(1, len(l) + 1)) i from (select doc_id, {SENTENCES} l from documents)"


def fragments_sql(key: str, table: str, places: bool = False) -> str:
    """The fragments of a table's texts, with the sentence they are from, place, if asked for."""
    sql = FRAGMENTS.replace("TABLE_", table)
    if places:
        sql = sql.replace(f"unnest({SENTENCES}) as text", f"unnest({SENTENCES}) as text, unnest(range(len({SENTENCES}))) as place").replace("KEY_", "KEY_, place", 3)
    return sql.replace("KEY_", key)
