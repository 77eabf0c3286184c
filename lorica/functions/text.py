"""Text functions as column expressions. What they cannot say (NFKD, chunking) is in python_udfs.py."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What JavaScript calls white space. Fixed values.
WHITE = r"[\t\n\x0B\f\r    -     　﻿]"
NO_WHITE = WHITE.replace("[", "[^", 1)
#: Formats of the texts, fixed: an address, what is markup, and runs of either markup or white space.
ADDRESS = f"https?://{NO_WHITE}+"
_MARKUP = r"<[^>]+>|[`*_>#\[\]()|~!-]"
_BETWEEN = f"(?:{_MARKUP}|{WHITE})+"
READING_SPEED = 170


def replace_all(text: Column, *rules: tuple[str, str]) -> Column:
    """Regular expressions replaced one after the other."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def replace_where(text: Column, *rules: tuple[str, str, str]) -> Column:
    """Rules (a literal that every match has, pattern, replacement): texts without the literal are passed over. The empty
    literal is in every text."""
    return reduce(lambda t, r: F.when(F.contains(t, F.lit(r[0])), F.regexp_replace(t, r[1], r[2])).otherwise(t) if r[0] else F.regexp_replace(t, r[1], r[2]), rules, text)


def trim(text: Column) -> Column:
    """Without white space (of every kind) at both ends."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def without_front_block(text: Column) -> Column:
    """Drops the first block between two lines that start with ---, and only the first."""
    return replace_where(text, ("---", r"(?s)\A((?:(?!^---).)*?)^---.*?---(.*)\z".replace("^", "(?m:^)"), "$1$2"))


def word_count(body: Column) -> Column:
    """Words of a Markdown text: the text of links and images counts, addresses and markup do not."""
    plain = replace_where(without_front_block(body), ("![", r"!\[([^\]]*)\]\([^)]+\)", "$1"), ("](", r"\[([^\]]+)\]\([^)]+\)", "$1"), ("://", ADDRESS, " "))
    return F.size(F.filter(F.split(plain, _BETWEEN), lambda w: w != "")).cast("long")


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(words / F.lit(READING_SPEED))).cast("long")


def excerpt(body: Column, length: int = 420) -> Column:
    """Plain text of a Markdown text: comments and images go, the text of links stays; the first ``length`` characters."""
    def cleaned(text: Column) -> Column:
        plain = replace_where(text, ("<!--", r"(?s)<!--.*?-->", " "), ("![", r"!\[[^\]]*\]\([^)]+\)", " "), ("](", r"\[([^\]]+)\]\([^)]+\)", "$1"), ("://", ADDRESS, " "))
        return F.trim(F.regexp_replace(plain, _BETWEEN, " "))

    # a beginning without an opened bracket has nothing that reaches beyond it but an address at its very end
    head = F.left(body, F.lit(4 * length))
    own = cleaned(head)
    enough = ~F.contains(head, F.lit("<")) & ~F.contains(head, F.lit("[")) & (F.char_length(own) >= length + 16)
    return F.when(enough, F.left(own, F.lit(length))).otherwise(F.left(cleaned(body), F.lit(length)))


#: Markdown of one block as it is read aloud: images and addresses go, signs of emphasis go, spaces are squeezed. Rules as
#: of replace_where(), formats fixed; python_udfs.inline_of() applies the same ones.
INLINE = (
    ("![", r"!\[[^\]]*\]\([^)]*\)", " "), ("](", r"\[([^\]]+)\]\([^)]*\)", "$1"), ("<", r"<[^>]+>", " "), ("", r"[*_~`]", ""),
    ("://", r"\([^)]*https?://[^)]*\)", " "), ("://", ADDRESS, " "), ("", f"{WHITE}+([،؛؟.!])", "$1"), ("", r"[ \t]+", " "))


def inline_text(text: Column) -> Column:
    return trim(replace_where(text, *INLINE))


def without_references(body: Column, arabic: bool = False) -> Column:
    """Cuts the list of references at the end. The ASCII word border after the heading never holds after an Arabic
    letter, so only the English heading is found; arabic=True finds the Arabic ones too."""
    names = r"References?(?![A-Za-z0-9_])"
    if arabic:
        names = rf"(?:المصادر|المراجع|{names})"
    return trim(F.regexp_replace(body, rf"(?is)\n##\s+{names}.*$", ""))


def escape_xml(text: Column) -> Column:
    rules = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), rules, text)


def encode_component(text: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) as they are."""
    rules = (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"))
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), rules, F.url_encode(text))


def replaced_in_order(text: Column, rules: Column) -> Column:
    """Literal rules (array of struct from, to) applied one after the other, longest first, ties in the given order."""
    numbered = F.transform(rules, lambda r, i: F.struct((-F.char_length(r["from"])).alias("k"), i.alias("i"), r.alias("r")))
    return F.aggregate(F.array_sort(numbered), text, lambda t, x: F.replace(t, x["r"]["from"], x["r"]["to"]))


def speech_text(text: Column) -> Column:
    """Percent signs and ranges in words, line breaks as full stops."""
    return trim(replace_all(text, (rf"(\d+(?:[.,]\d+)?){WHITE}*%", "$1 في المئة"), (rf"(?<![A-Za-z0-9_])(\d+){WHITE}*[–—-]{WHITE}*(\d+)(?![A-Za-z0-9_])", "$1 إلى $2"), (r"\n+", ". "), (r"\.{2,}", "."), (f"{WHITE}+", " ")))


def spoken(text: Column, rules: Column) -> Column:
    """A text as it is read: literal rules first (see replaced_in_order), then numbers and lines."""
    return speech_text(replaced_in_order(text, rules))


def speech_weight(text: Column) -> Column:
    """A length in time: words, letters and pauses."""
    words = F.size(F.filter(F.split(text, f"{WHITE}+"), lambda w: w != ""))
    letters = F.char_length(F.regexp_replace(text, WHITE, ""))
    return F.greatest(F.lit(1.0), words + letters / 22 + F.regexp_count(text, F.lit("[.!؟]")) * 1.1 + F.regexp_count(text, F.lit("[،؛:]")) * 0.45)


def compact_title(title: Column, most: int = 42) -> Column:
    """So many whole words as fit; a first word that does not fit is cut."""
    def add(s: Column, w: Column) -> Column:
        new = F.when(s["t"] == "", w).otherwise(F.concat(s["t"], F.lit(" "), w))
        fits = ~s["stop"] & (F.char_length(new) <= most)
        return F.struct(F.when(fits, new).otherwise(s["t"]).alias("t"), (~fits).alias("stop"))

    kept = F.aggregate(F.split(title, f"{WHITE}+"), F.struct(F.lit("").alias("t"), F.lit(False).alias("stop")), add)["t"]
    return F.when(F.char_length(title) <= most, title).otherwise(F.when(kept != "", kept).otherwise(F.left(title, F.lit(most))))


def meta_description(text: Column) -> Column:
    squeezed = trim(F.regexp_replace(text, f"{WHITE}+", " "))
    return F.when(F.char_length(squeezed) > 160, F.concat(F.rtrim(F.left(squeezed, F.lit(157))), F.lit("…"))).otherwise(squeezed)


def crumb(text: Column) -> Column:
    return F.when(F.char_length(text) > 54, F.concat(F.rtrim(F.left(text, F.lit(51))), F.lit("…"))).otherwise(text)


ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩٬"


def arabic_number(n: Column) -> Column:
    return F.translate(F.format_number(n, 0), "0123456789,", ARABIC_DIGITS)


def article_count_label(n: Column) -> Column:
    some = F.when(n <= 10, F.concat(arabic_number(n), F.lit(" مقالات"))).otherwise(F.concat(arabic_number(n), F.lit(" مقالًا")))
    return F.when(n == 0, "لا مقالات منشورة").when(n == 1, "مقال واحد").when(n == 2, "مقالان").otherwise(some)


def minutes_label(n: Column) -> Column:
    return F.when(n == 1, "دقيقة قراءة").when(n == 2, "دقيقتا قراءة").when((n >= 3) & (n <= 10), F.concat(arabic_number(n), F.lit(" دقائق قراءة"))).otherwise(F.concat(arabic_number(n), F.lit(" دقيقة قراءة")))


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def image_set(path: Column, kind: str = "posts") -> Column:
    """struct(src, srcset) of a picture in the folder of its kind; other paths have no set."""
    folder = {"posts": "/images/generated", "thumbnails": "/images/thumbnails"}[kind]
    name = base_name(path)
    widths = F.array_join(F.array(*(F.concat(F.lit(folder + "/"), name, F.lit(f"-{w}.webp {w}w")) for w in (320, 640, 960, 1280))), ", ")
    own = path.startswith(f"/images/{kind}/")
    return F.struct(F.when(own, F.concat(F.lit(folder + "/"), name, F.lit("-640.webp"))).otherwise(path).alias("src"), F.when(own, widths).alias("srcset"))


def branded_title(title: Column, brand: str, tagline: str, most: int = 65) -> Column:
    """A page's title: with the brand behind it as long as both fit (counted in UTF-16 units), the brand's own page with
    its tagline. The limit is a fixed value."""
    branded = F.concat(title, F.lit(f" | {brand}"))
    units = (F.octet_length(F.encode(branded, "UTF-16BE")) / 2).cast("int")
    return F.when(title == brand, f"{brand} — {tagline}").when(units <= most, branded).otherwise(title)


def picture_of(path: Column, use: str) -> Column:
    """The file that stands for a picture as a thumbnail or in social media; paths of other folders stay as they are."""
    own, thumbnail = path.startswith("/images/posts/"), path.startswith("/images/thumbnails/")
    made = lambda folder, end: F.concat(F.lit(f"/images/{folder}/"), base_name(path), F.lit(end))
    if use == "social":
        return F.when(own | thumbnail, made("social", "-social.jpg")).otherwise(path)
    return F.when(thumbnail, made("thumbnails", "-320.webp")).when(own, made("generated", "-320.webp")).otherwise(path)


def plain_html(text: Column) -> Column:
    return F.trim(replace_all(text, (r"<[^>]+>", ""), (r"&(?:amp|quot|#39|lt|gt);", " "), (f"{WHITE}+", " ")))
