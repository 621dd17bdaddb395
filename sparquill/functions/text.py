"""Text functions: name keys, words, cell values, digests.

Where the JVM has no match for a rule (NFKC, case folding, difflib), a pandas
UDF works on Arrow batches; everything else is built of Spark's functions.
"""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
LINE_BREAKS = r"\R|[\x1c-\x1e]"  # with Java's \R: the breaks of Python's splitlines
SEPARATORS = r"[\s_\-・'’`.．。@]+"
WORD_BREAKS = r"[\s_・]+"
PLACEHOLDERS = ("-", "‐", "–", "—", "―", "−", "－", "ー")
QUOTES = " 　「」『』\"'"
REPLACEMENT = "�"
# Patterns of name cells (struck names, bracketed notes, note marks, breaks between names).
STRUCK, BRACKETED, NOTE_MARK, NAME_BREAKS = "~~.*?~~", "[（(][^）)]*[）)]", r"[*＊]\d+", r"[、,，/／;；]\s*|\s{2,}"
# Patterns of profile rows (the row that lists accounts, an account, a name with its reading).
ACCOUNT_ROW = r"^\|\s*X\s*(?:[（(]旧\s*Twitter[）)]|\(Twitter\)|（Twitter）)\s*\|([^|]*)\|"
ACCOUNT = r"(?<![A-Za-z0-9_])(@[A-Za-z0-9_]{1,15})(?![A-Za-z0-9_])"
READING_ROW = r"^\|\s*\[colspan=\d+\]\s*([^|（(]+?)\s*[（(]([^|（()）]+)[）)]"

# Names that no index may take for a person's own, and the titles among them that enough rows can give to one.
GENERIC_WORDS = (
    "私 わたし わたくし あたし あたい 僕 ぼく 俺 おれ おいら おら うち 自分 余 我 吾輩 わがはい ワイ 拙者 あーし"
    " わっち あちき 小生 本人 先輩 せんぱい パイセン 後輩 同期 相方 ちゃん さん くん 君 きみ 様 さま たん 氏 殿 姉 姉さん"
    " 姉ちゃん お姉ちゃん おねえちゃん ねえさん 兄 兄貴 お兄ちゃん 妹 弟 ママ まま パパ 母 父 お母さん 母上 娘 息子 嫁 旦那"
    " 彼女 彼氏 先生 社長 会長 部長 団長 隊長 総帥 姫 王 女王 師匠 お嬢 お嬢様 あなた あんた お前 おまえ みんな 皆 全員"
    " ホロメン リスナー 視聴者 ファン 友達 友人 あいつ こいつ そいつ"
).split()
ROLE_TITLES = "会長 社長 部長 団長 隊長 総帥 姫 王 女王 師匠 先生 お嬢 お嬢様".split()

_KATAKANA = {c: c + 0x60 for c in range(ord("ぁ"), ord("ゖ") + 1)}


def fold_text(text: str) -> str:
    folded = unicodedata.normalize("NFKC", text).casefold().translate(_KATAKANA)
    return re.sub(SEPARATORS, "", folded)


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    """The key under which names compare: NFKC, case folded, katakana, no separators."""
    return texts.map(fold_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def words(texts: pd.Series) -> pd.Series:
    """Folded words of a name, in order, without empty ones."""
    return texts.map(lambda t: [w for w in map(fold_text, re.split(WORD_BREAKS, unicodedata.normalize("NFKC", t))) if w], na_action="ignore")


@F.pandas_udf(T.DoubleType())
def closeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def ascii_fold(text: Column) -> Column:
    """``fold`` for text that is known to be ASCII, without leaving the JVM."""
    return F.regexp_replace(F.lower(text), r"[ \t\n\r_.'`@-]", "")


def lines_of(text: Column) -> Column:
    """Array of the lines that are not blank, in order."""
    return F.filter(F.split(text, LINE_BREAKS), lambda line: F.trim(line) != "")


def collapse(text: Column) -> Column:
    """Runs of any white space become one space."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def cell_value(text: Column) -> Column:
    """A cell without its trailing note marks; one that only holds a dash is empty."""
    bare = F.trim(collapse(F.regexp_replace(text, r"\s*[*※]\d+\s*$", "")))
    return F.when(bare.isin(*PLACEHOLDERS), F.lit("")).otherwise(bare)


def split_names(cell: Column) -> Column:
    """Current names in a cell: no struck ones, no bracketed notes, no note marks."""
    plain = cell
    for dropped in (STRUCK, BRACKETED, NOTE_MARK):
        plain = F.regexp_replace(plain, dropped, "")
    parts = F.transform(F.split(plain, NAME_BREAKS), lambda p: F.regexp_replace(p, f"^[{QUOTES}]+|[{QUOTES}]+$", ""))
    return F.filter(parts, lambda p: p != "")


def accounts(lines: Column) -> Column:
    """Distinct @handles in the second cell of the profile rows that list accounts."""
    cells = F.transform(lines, lambda x: F.regexp_extract(F.trim(x), ACCOUNT_ROW, 1))
    return F.array_distinct(F.regexp_extract_all(F.array_join(cells, " "), F.lit(ACCOUNT), 1))


@F.pandas_udf(T.ArrayType(T.StringType()))
def fold_each(texts: pd.Series) -> pd.Series:
    """``fold`` of every text of an array."""
    return texts.map(lambda ts: [None if t is None else fold_text(t) for t in ts], na_action="ignore")


def reading(lines: Column, name: Column) -> Column:
    """The reading in brackets in the first table row that has the name, as folds
    compare; null if there is none or it is the name itself."""
    pattern = r"(?U)^\s*" + READING_ROW.removeprefix("^")
    rows = F.filter(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("of"), F.regexp_extract(x, pattern, 2).alias("said"))), lambda r: r["of"] != "")
    first = F.nullif(F.array_position(fold_each(F.transform(rows, lambda r: r["of"])), fold(name)), F.lit(0)).cast("int")
    said = F.regexp_replace(F.try_element_at(F.transform(rows, lambda r: r["said"]), first), r"(?U)^\s+|\s+$", "")
    return F.when(fold(said) != fold(name), said)


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Character references as characters; call it on texts that hold an ampersand."""
    return texts.map(html.unescape, na_action="ignore")


def replacements(text: Column) -> Column:
    """How many U+FFFD a text holds."""
    return (F.length(text) - F.length(F.replace(text, F.lit(REPLACEMENT), F.lit("")))).cast("long")


def record_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def expand_label(label: Column, href: Column) -> Column:
    """A link's label that is its own address cut short becomes the address."""
    stem = F.regexp_replace(label, r"(?:\.\.\.|…)$", "")
    return F.when(label.rlike(r"^https?.*(?:\.\.\.|…)$") & F.startswith(href, stem), href).otherwise(label)
