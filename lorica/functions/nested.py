"""Nested and dynamic values: JSON that may fail, fallbacks between old and new forms, maps, defaults, settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = "struct<type:string,text:string,data:string>"
#: An answer of a speech service: steps with content, or the older outputs (blocks, or lists of blocks), or one block.
ANSWER = f"struct<status:string,steps:array<struct<type:string,content:array<{BLOCK}>>>,outputs:array<struct<type:string,text:string,data:string,content:array<{BLOCK}>>>,output_audio:{BLOCK},outputAudio:{BLOCK}>"


def parsed(json: Column, schema: str) -> Column:
    """The value of a JSON text; null, or a struct of nulls, for what is no JSON of that form."""
    return F.from_json(json, schema, {"mode": "PERMISSIVE"})


def parsed_list(json: Column, item: str = "string") -> Column:
    """A JSON list; the empty list for anything else."""
    return F.coalesce(F.from_json(json, f"array<{item}>"), F.array().cast(f"array<{item}>"))


def _listed(x: Column, kind: str) -> Column:
    return F.coalesce(x, F.array().cast(f"array<{kind}>"))


def step_content(answer: Column) -> Column:
    """All blocks of all steps, in order."""
    return _listed(F.flatten(F.transform(answer["steps"], lambda s: _listed(s["content"], BLOCK))), BLOCK)


def answer_audio(answer: Column) -> Column:
    """The first block of sound: in the steps, in the outputs, then the single fields; null if there is none."""
    own = lambda o: F.array(F.struct(o["type"].alias("type"), o["text"].alias("text"), o["data"].alias("data")).cast(BLOCK))
    outputs = F.flatten(F.transform(answer["outputs"], lambda o: F.coalesce(o["content"], own(o))))
    sound = F.filter(F.concat(step_content(answer), _listed(outputs, BLOCK)), lambda b: (b["type"] == "audio") & b["data"].isNotNull())
    return F.coalesce(F.try_element_at(sound, F.lit(1)), answer["output_audio"], answer["outputAudio"])


def answer_summary(answer: Column) -> Column:
    """The status and the types in an answer as one line."""
    types = lambda x: F.array_join(F.transform(x, lambda v: F.coalesce(v["type"], F.lit("unknown"))), ",")
    named = lambda x: F.when(F.coalesce(x, F.lit("")) == "", "none").otherwise(x)
    return F.concat(F.lit("status="), F.coalesce(answer["status"], F.lit("unknown")), F.lit("; steps="), named(types(answer["steps"])), F.lit("; content="), named(types(step_content(answer))))


def asset(part: Column, voice: Column) -> Column:
    """A part's asset for a voice: audio (map by voice), or the part's own src and seconds as older manifests have them."""
    old = F.when(part["src"].isNotNull(), F.struct(part["src"].alias("src"), part["seconds"].alias("seconds")))
    return F.coalesce(F.try_element_at(part["audio"], voice), old)


def first_set(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def merged_settings(local: Column, process: Column) -> Column:
    """Two maps of settings; what the process has set wins."""
    return F.map_concat(F.map_filter(local, lambda k, _: ~F.map_contains_key(process, k)), process)


def missing_settings(settings: Column, names: list[str]) -> Column:
    """Those names that the map does not set, in the given order."""
    return F.filter(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.try_element_at(settings, n), F.lit("")) == "")


def decoded(text: Column) -> Column:
    """Percent-decoded, or as it is where that fails. A plus sign is no space here."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def escaped_json(value: Column) -> Column:
    """A value as JSON that may stand in a page: < is written as an escape."""
    return F.replace(F.to_json(value), F.lit("<"), F.lit("\\u003c"))


def escape_html(text: Column) -> Column:
    rules = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), rules, text)


def preference_key(provider: Column) -> Column:
    """The key of a reader's choice of voice; null is the default provider."""
    return F.concat(F.lit("audio-voice-v1:"), F.regexp_replace(F.lower(first_set(provider, F.lit("default"))), "[^a-z0-9]+", "-"))


def part_file(voice: Column, part: Column, digest: Column) -> Column:
    """voice-part-003-1a2b3c4d.mp3"""
    return F.format_string("%s-part-%03d-%s.mp3", voice, part, F.left(digest, F.lit(8)))


def ssml(language: str, voice: Column, text: Column) -> Column:
    """A request for speech; text is escaped."""
    from .text import escape_xml

    return F.concat(F.lit(f'<speak version="1.0" xml:lang="{language}"><voice name="'), voice, F.lit('">'), escape_xml(text), F.lit("</voice></speak>"))


def in_future(ts: Column, now: Column, minutes: int = 5) -> Column:
    """Whether a time lies so far ahead that no clock is to blame."""
    return ts > now + F.make_dt_interval(mins=F.lit(minutes))


def wide(width: Column, height: Column) -> Column:
    """16 to 9."""
    return width * 9 == height * 16


def read_percent(scrolled: Column, start: Column, length: Column) -> Column:
    """How much of an article is read, 0 to 100, halves upwards."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (scrolled - start) / F.greatest(F.lit(1), length)))
    return F.floor(share * 100 + 0.5).cast("long")


def safe_number(text: Column, default: float = 0.0) -> Column:
    """A number from a text; the default for what is none, not a number or endless."""
    n = text.try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), F.lit(default)).otherwise(n)


def sound_bytes(data: Column) -> Column:
    """The bytes of base64 text, null if it is none or begins like no MP3 (an ID3 tag or a frame's eleven set bits)."""
    raw = F.try_to_binary(data, F.lit("base64"))
    head = F.hex(F.substring(raw, 1, 3))
    return F.when(head.startswith("494433") | head.rlike("^FF[EF]"), raw)
