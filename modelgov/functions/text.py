"""Text, key and name expressions shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_SEP = "$$"
# The column by which tables of keys may be dealt (see ``key_place``).
PLACE = "_place"

# White space of any script, as one character class.
SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    """Drop white space (tabs and newlines included) at both ends."""
    return F.regexp_replace(_c(col), rf"\A{SPACE}+|{SPACE}+\z", "")


def clean_text(col: Column | str) -> Column:
    """Null becomes empty, runs of white space become one blank, ends are trimmed.

    Names are cleaned for every row of every join, so text is replaced only where one look finds two blanks or a
    character beside printable ASCII.
    """
    text = F.coalesce(_c(col), F.lit(""))
    return F.trim(F.when(text.rlike("  |[^ -~]"), F.regexp_replace(text, rf"{SPACE}+", " ")).otherwise(text))


def normalize_key(col: Column | str) -> Column:
    """Matching form of a key: lower case, collapsed white space, one trailing '?' dropped."""
    text = F.lower(clean_text(col))
    return F.when(text.endswith("?"), F.regexp_replace(text, r"\s*\?\s*\z", "")).otherwise(text)


def build_key(table: Column | str, column: Column | str) -> Column:
    return F.concat(F.trim(_c(table)), F.lit(KEY_SEP), F.trim(_c(column)))


def key_table(key: Column | str) -> Column:
    return F.substring_index(_c(key), KEY_SEP, 1)


def key_column(key: Column | str) -> Column:
    """Everything after the first separator; null when there is none."""
    key = _c(key)
    at = F.instr(key, KEY_SEP)
    return F.when(at > 0, F.substring(key, at + len(KEY_SEP), F.length(key)))


def key_place(key_norm: Column | str) -> Column:
    """The table's part of a normalised key: equal keys have one place, and so have all columns of a table."""
    return F.substring_index(_c(key_norm), KEY_SEP, 1)


def placed(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` dealt by the place of its keys if ``like`` is, so that both meet without moving ``like``."""
    return df.withColumn(PLACE, key_place("key_norm")).repartition("model_id", PLACE) if PLACE in like.columns else df


def key_columns(df: DataFrame) -> list[str]:
    """The columns by which rows of ``df`` are met: model and key, with the place between if ``df`` has one."""
    return ["model_id", *([PLACE] if PLACE in df.columns else []), "key_norm"]


def norm_pair(table: Column | str, column: Column | str) -> Column:
    """Normalised Table$$Column key."""
    return normalize_key(build_key(table, column))


def blank_to_null(col: Column | str) -> Column:
    return F.nullif(strip(col), F.lit(""))


def unquote(col: Column | str) -> Column:
    """Name as written in definition text -> plain name ('' inside quotes is one quote)."""
    text = strip(col)
    quoted = text.rlike(r"(?s)\A'.*'\z") & (F.length(text) >= 2)
    inner = F.regexp_replace(F.regexp_replace(text, r"(?s)\A'(.*)'\z", "$1"), "''", "'")
    return F.when(quoted, inner).otherwise(text)


def quote_name(col: Column | str) -> Column:
    """Quote a name for definition text when it holds a blank or a quote."""
    name = _c(col)
    return F.when(
        name.rlike("[ ']"), F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'"))
    ).otherwise(name)


def column_ref(table: Column | str, column: Column | str) -> Column:
    return F.concat(quote_name(table), F.lit("."), quote_name(column))


def safe_file_name(col: Column | str) -> Column:
    """Replace characters that file systems reject."""
    return F.trim(F.regexp_replace(_c(col), r'[<>:"/\\|?*]', "_"))


def sql_identifier(col: Column | str) -> Column:
    """Bracketed SQL identifier with closing brackets doubled."""
    return F.concat(F.lit("["), F.replace(_c(col), F.lit("]"), F.lit("]]")), F.lit("]"))


def safe_int(col: Column | str, default: int | None = None) -> Column:
    return F.coalesce(_c(col).try_cast("int"), F.lit(default).cast("int"))


def safe_str(col: Column | str, default: str = "") -> Column:
    return F.coalesce(_c(col).cast("string"), F.lit(default))


def safe_bool(col: Column | str) -> Column:
    """0/1, true/false or null -> boolean (null and unreadable are false)."""
    text = F.lower(_c(col).cast("string"))
    return F.coalesce(text.try_cast("double") != 0, text == "true", F.lit(False))


def normalise_definition(col: Column | str) -> Column:
    """Strip a leading byte-order mark and turn CR/CRLF into LF."""
    return F.regexp_replace(F.regexp_replace(_c(col), "\\A\ufeff", ""), r"\r\n?", "\n")
