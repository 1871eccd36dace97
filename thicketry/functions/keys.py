"""Keys, names and paths."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicketry.functions.vectors import col

IMAGE_ENDINGS = ("png", "jpg", "jpeg")


def sample_key(subset: Column | str, stem: Column | str) -> Column:
    return F.concat_ws("/", col(subset), col(stem))


def first_part(key: Column | str) -> Column:
    return F.substring_index(col(key), "/", 1)


def slashes(path: Column | str) -> Column:
    return F.translate(col(path), "\\", "/")


def base_name(path: Column | str) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def ending(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([A-Za-z0-9]+)$", 1))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(base_name(path), r"\.[A-Za-z0-9]+$", "")


def is_image(path: Column | str, endings: tuple[str, ...] = IMAGE_ENDINGS) -> Column:
    return ending(path).isin(*endings)


def subset_of_path(path: Column | str, leaves: tuple[str, ...] = ("im", "imgs", "images")) -> Column:
    """The folder of a file, or the one above it if that is a leaf like ``im``."""
    parts = F.split(slashes(path), "/")
    own = F.element_at(parts, -2)
    return F.when(F.size(parts) < 2, F.lit(None)).otherwise(F.when(F.lower(own).isin(*leaves) & (F.size(parts) > 2), F.element_at(parts, -3)).otherwise(own))


def is_safe_path(path: Column | str) -> Column:
    """Relative, and nowhere upward."""
    p = slashes(path)
    return ~(p.startswith("/") | p.rlike(r"^[A-Za-z]+:") | p.rlike(r"(^|/)\.\.(/|$)"))


def is_canonical_text(x: Column | str) -> Column:
    x = col(x)
    return (x != "") & (F.trim(x) == x) & ~x.rlike(r"[\r\n\\]")


def tidy_key(key: Column | str) -> Column:
    """Slashes, no empty or dot parts, no blanks around; composition of accents is left as it is."""
    parts = F.filter(F.split(slashes(F.regexp_replace(col(key), r"^\s+|\s+$", "")), "/"), lambda p: (p != "") & (p != "."))
    return F.nullif(F.array_join(parts, "/"), F.lit(""))


@F.pandas_udf(T.StringType())
def _nfc(s):  # pragma: no cover - runs in workers
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def normalize_key(key: Column | str) -> Column:
    """``tidy_key`` with composed accents; only texts beyond ASCII leave the JVM's fast path in effect."""
    return tidy_key(_nfc(col(key)))


def padded(n: Column | str, width: int = 4) -> Column:
    return F.lpad(col(n).cast("string"), width, "0")


def fixed(x: Column | str, digits: int = 10) -> Column:
    return F.format_string(f"%.{digits}f", col(x).cast("double"))
