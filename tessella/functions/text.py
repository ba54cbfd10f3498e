r"""Text functions as column expressions.

White space is that of ASCII: space, tab, line feed, form feed, carriage return. Null text gives null throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\f\r]"
LINK = r"\[([^\]]+)\]\([^\)]+\)"
#: First bytes of the image kinds that base64 input may hold.
MAGIC = (("png", "89504E47"), ("jpg", "FFD8FF"), ("gif", "47494638"), ("bmp", "424D"), ("webp", "52494646"))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def hash_bucket(token: Column, dim: int) -> Column:
    """The first 32 bits of the token's md5, modulo dim."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint") % dim


def link_unwrap(text: Column) -> Column:
    """T4: [label](target) becomes label; an image keeps its exclamation mark."""
    return F.regexp_replace(text, LINK, "$1")


def words(text: Column) -> Column:
    """Runs of other characters than white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """T11."""
    return F.size(words(text)).cast("bigint")


def blank_line_clean(text: Column) -> Column:
    """Lines that hold something else than white space."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\f\r]")), "\n")


def basename(path: Column) -> Column:
    r"""What follows the last / or \."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the basename, in lower case; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"\.([A-Za-z0-9]+)$", 1))


def html_strip(html: Column) -> Column:
    """Visible text on one line: without scripts, styles and tags (the simple variant of T3)."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), f"{SPACE}+", " "))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), f"{SPACE}+", " "))


def lossy_decode(content: Column) -> Column:
    """Bytes as UTF-8, U+FFFD in place of what isn't."""
    return F.call_function("make_valid_utf8", content.cast("string"))


def overlap_of(size: Column, ratio: Column) -> Column:
    """T5: rounded down."""
    return F.floor(size * ratio).cast("bigint")


def query_prompt(instruction: Column, query: Column) -> Column:
    """T12."""
    return F.concat(F.lit("<Instruct>: "), instruction, F.lit("\n<Query>: "), query)


def document_prompt(document: Column) -> Column:
    return F.concat(F.lit("<Document>: "), document)


def title_of(text: Column) -> Column:
    """The first line."""
    return F.substring_index(text, "\n", 1)


def body_of(text: Column) -> Column:
    """What follows the first line; empty where there is one line."""
    return F.when(F.instr(text, "\n") > 0, F.substr(text, F.instr(text, "\n") + 1)).otherwise(F.when(text.isNotNull(), F.lit("")))


def last_tag(text: Column, tag: str) -> Column:
    """The content of the last <tag>…</tag>, null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), F.lit(-1))


def is_base64_image(text: Column) -> Column:
    """A data URL of an image, or at least 100 characters of base64 that decode."""
    payload = F.regexp_replace(text, f"{SPACE}+", "")
    plain = (F.length(payload) >= 100) & payload.rlike("^[A-Za-z0-9+/]+={0,2}$") & F.try_to_binary(payload, F.lit("base64")).isNotNull()
    return F.when(text.isNotNull(), text.startswith("data:image/") | F.coalesce(plain, F.lit(False)))


def image_kind(content: Column) -> Column:
    """The kind that the first bytes tell, else null."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(None).cast("string")
    for kind, magic in reversed(MAGIC):
        out = F.when(head.startswith(magic), kind).otherwise(out)
    return out
