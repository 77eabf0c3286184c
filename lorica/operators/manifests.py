"""Manifests of narrated articles: which may be used, what they lack, and what they add up to.

A manifest is a row: article_id, version, source_hash, default_voice, voices array<struct<id, provider_voice, label,
seconds>> and parts array<struct<sync array<struct<id, type, start, end>>, audio map<string, struct<src, bytes, sha256,
seconds>>, src>>. Rules are column expressions over one row; assets become rows only when all of them hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYNC = "array<struct<id:string,type:string,start:double,end:double>>"
ASSET = "struct<src:string,bytes:bigint,sha256:string,seconds:double>"
PARTS = f"array<struct<sync:{SYNC},audio:map<string,{ASSET}>,src:string>>"
VOICES = "array<struct<id:string,provider_voice:string,label:string,seconds:double>>"


def _every(x: Column, rule) -> Column:
    """Whether the list is there, not empty, and the rule holds for each entry (a rule that is null does not)."""
    return F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(rule(v), F.lit(False))), F.lit(False))


def _pairs(parts: Column, voices: Column) -> Column:
    """The asset of each part and voice, null where the part lacks it."""
    return F.flatten(F.transform(parts, lambda p: F.transform(voices, lambda v: F.try_element_at(p["audio"], v["id"]))))


def _ordered(sync: Column) -> Column:
    """Whether no entry starts before the one before it."""
    after = F.slice(sync, F.lit(2), F.greatest(F.size(sync) - 1, F.lit(0)))
    before = F.slice(sync, F.lit(1), F.greatest(F.size(sync) - 1, F.lit(0)))
    return F.forall(F.zip_with(after, before, lambda a, b: a["start"] >= b["start"]), lambda ok: ok)


def ratio_ok(e: Column) -> Column:
    return (e["start"] >= 0) & (e["end"] <= 1) & (e["start"] < e["end"])


def playable(parts: Column, voices: Column) -> Column:
    """What a reader's page asks of a manifest: every part has sync; with voices, every part has sound for each of them,
    without, every part has its own."""
    ids = F.filter(F.transform(voices, lambda v: v["id"]), lambda i: F.coalesce(i, F.lit("")) != "")
    sound = lambda p: F.forall(ids, lambda i: F.coalesce(F.try_element_at(p["audio"], i)["src"].endswith(".mp3") & (F.try_element_at(p["audio"], i)["seconds"] > 0), F.lit(False)))
    with_voices = (F.size(ids) == F.size(voices)) & _every(parts, sound)
    return _every(parts, lambda p: p["sync"].isNotNull()) & F.when(F.size(F.coalesce(voices, F.array().cast(VOICES))) > 0, with_voices).otherwise(_every(parts, lambda p: p["src"].endswith(".mp3")))


#: What each version of manifests is asked: the least bytes of an asset, whether sync is checked entry by entry, and
#: whether the sums of seconds must agree. Fixed values.
VERSIONS = {3: (100, False, False), 4: (100, True, False), 5: (1, True, True)}
TOLERANCE = 0.1


def broken_rules(wanted_hash: Column, prefix: Column) -> Column:
    """The names of the rules that a manifest breaks, for the version it says it is. prefix: where assets must lie."""
    voices, parts = F.col("voices"), F.col("parts")
    assets = _pairs(parts, voices)
    paths = F.filter(F.transform(assets, lambda a: a["src"]), lambda s: s.isNotNull())
    known = F.col("version").isin(*VERSIONS)
    by_version = lambda i: F.create_map(*(F.lit(x) for v, rules in VERSIONS.items() for x in (v, rules[i])))[F.col("version")]
    entries = F.flatten(F.transform(parts, lambda p: p["sync"]))
    ids = F.transform(entries, lambda e: e["id"])
    per_voice = lambda v: F.aggregate(parts, F.lit(0.0), lambda s, p: s + F.try_element_at(p["audio"], v["id"])["seconds"])
    rules = {
        "version": known,
        "source": F.col("source_hash") == wanted_hash,
        "voices": _every(voices, lambda v: (v["id"] != "") & (v["provider_voice"] != "") & v["label"].isNotNull() & (v["seconds"] > 0)),
        "default_voice": F.exists(voices, lambda v: v["id"] == F.col("default_voice")),
        "assets": _every(assets, lambda a: a["src"].startswith(prefix) & a["src"].endswith(".mp3") & (a["bytes"] >= by_version(0)) & (a["seconds"] > 0)),
        "paths": F.size(F.array_distinct(paths)) == F.size(paths),
        "sync": ~by_version(1) | (_every(parts, lambda p: _every(p["sync"], ratio_ok) & _ordered(p["sync"])) & (F.size(F.array_distinct(ids)) == F.size(ids))),
        "seconds": ~by_version(2) | F.forall(voices, lambda v: F.abs(per_voice(v) - v["seconds"]) <= TOLERANCE),
    }
    said = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    return F.when(~F.coalesce(known, F.lit(False)), F.array(F.lit("version"))).otherwise(F.array_compact(said))


def failures(manifests: DataFrame, wanted: DataFrame, root: str) -> DataFrame:
    """(article_id, rule) of what each manifest breaks. wanted: (article_id, wanted_hash, key); root/key/ holds assets."""
    both = manifests.join(wanted, "article_id")
    return both.select("article_id", F.explode(broken_rules(F.col("wanted_hash"), F.concat(F.lit(f"{root}/"), F.col("key"), F.lit("/")))).alias("rule"))


def assets(manifests: DataFrame, wanted: DataFrame, root: str) -> DataFrame:
    """(article_id, part, voice, src, seconds) of the manifests that break no rule."""
    whole = manifests.join(wanted, "article_id").where(F.size(broken_rules(F.col("wanted_hash"), F.concat(F.lit(f"{root}/"), F.col("key"), F.lit("/")))) == 0)
    rows = whole.select("article_id", F.posexplode("parts").alias("part", "p")).select("article_id", "part", F.explode("p.audio").alias("voice", "a"))
    return rows.select("article_id", "part", "voice", "a.src", "a.seconds")


def sync_failures(plans: DataFrame) -> DataFrame:
    """(article_id, rule, id) of plans (article_id, segments array<string>, parts array of sync): ids of a wrong form,
    entries of unknown ids, shares out of range or order, and segments that are never read."""
    p = F.col("parts")
    entries = F.flatten(p)
    seen = F.transform(entries, lambda e: e["id"])
    late = lambda sync: F.filter(F.transform(sync, lambda e, i: F.struct(e["id"].alias("id"), ((i > 0) & (e["start"] < F.get(sync, i - 1)["start"])).alias("late"))), lambda x: x["late"])
    named = lambda rule, ids: F.transform(ids, lambda i: F.struct(F.lit(rule).alias("rule"), i.alias("id")))
    found = F.concat(
        named("form", F.filter("segments", lambda s: ~s.rlike("^b[0-9]{4}$"))),
        named("unknown", F.array_except(seen, F.col("segments"))),
        named("ratio", F.transform(F.filter(entries, lambda e: ~F.coalesce(ratio_ok(e), F.lit(False))), lambda e: e["id"])),
        named("order", F.transform(F.flatten(F.transform(p, late)), lambda x: x["id"])),
        named("never", F.array_except(F.col("segments"), seen)),
        F.when(F.size("segments") == 0, named("no_segments", F.array(F.lit("")))).otherwise(named("", F.array().cast("array<string>"))),
    )
    return plans.select("article_id", F.explode(found).alias("f")).select("article_id", "f.rule", "f.id")


def totals(plans: DataFrame) -> DataFrame:
    """Articles, parts and distinct segments of all plans."""
    return plans.agg(F.count("*").alias("articles"), F.sum(F.size("parts")).cast("long").alias("parts"), F.sum(F.size(F.array_distinct("segments"))).cast("long").alias("segments"))


def provider_counts(parts: DataFrame, recorded: list[str]) -> DataFrame:
    """Parts and seconds by kind of provider: recorded ones, and all others as made."""
    kind = F.when(F.col("provider").isin(*recorded), "recorded").otherwise("made")
    return parts.groupBy(kind.alias("kind")).agg(F.count("*").alias("parts"), F.sum("seconds").alias("seconds"))


def off_by_more(parts: DataFrame, declared: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(article_id, sum, declared) where the seconds of an article's parts differ from what it declares."""
    sums = parts.groupBy("article_id").agg(F.sum("seconds").alias("sum"))
    return declared.join(sums, "article_id").where(F.abs(F.col("sum") - F.col("declared")) > tolerance).select("article_id", "sum", "declared")


def covered(articles: DataFrame, coverage: DataFrame) -> DataFrame:
    """How many articles have all their parts: one row (articles, covered)."""
    have = coverage.where("complete").select("article_id").distinct().withColumn("_there", F.lit(True))
    return articles.join(have, "article_id", "left").agg(F.count("*").alias("articles"), F.count_if(F.col("_there").isNotNull()).alias("covered"))


def cache_hits(candidates: DataFrame, cases: DataFrame, made: DataFrame, files: DataFrame) -> DataFrame:
    """candidate ids whose kept fingerprint is the wanted one and whose files are all there. candidates: (candidate,
    fingerprint); made: (candidate, made_fingerprint, case_id, file); files: (candidate, file)."""
    same = candidates.join(made, "candidate").where("fingerprint = made_fingerprint").select("candidate", "case_id", "file")
    there = same.join(files, ["candidate", "file"], "left_semi").join(cases, "case_id", "left_semi").groupBy("candidate").agg(F.countDistinct("case_id").alias("n"))
    return there.crossJoin(cases.agg(F.countDistinct("case_id").alias("needed"))).where("n = needed").select("candidate")


def numbered_segments(parts: DataFrame) -> DataFrame:
    """parts (article_id, part, pos): each row's place in its article, over all parts."""
    w = Window.partitionBy("article_id").orderBy("part", "pos")
    return parts.withColumn("segment", F.row_number().over(w) - 1)


def chosen(posts: DataFrame, ids: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """(id, state) for the asked ids: 'take', 'unknown' if there is no such published article, 'skip' if another way has
    made it."""
    out = ids.select("id").distinct().join(posts.select("id", F.lit(True).alias("_there")), "id", "left")
    state = F.when(F.col("_there").isNull(), "unknown")
    if skipped is None:
        return out.select("id", state.otherwise("take").alias("state"))
    out = out.join(skipped.select("id", F.lit(True).alias("_skip")), "id", "left")
    return out.select("id", state.when(F.col("_skip"), "skip").otherwise("take").alias("state"))


def lacking(required: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """What is required and not available."""
    return required.select(key).distinct().join(available.select(key), key, "left_anti")
