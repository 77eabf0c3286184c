"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import alternate, let, placed, spans
from .store import texts

#: Patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

WINDOW = 20
#: Character classes of the entropy scan: kind, alphabet, bits a character that a window must reach. A window of 20
#: characters drawn evenly has about 3.4 bits over 16 characters and 4.1 over 64; invented or real words have fewer.
CLASSES = [
    ("entropy_hex", "0123456789abcdef", 3.0),
    ("entropy_upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.6),
    ("entropy_hex_upper", "0123456789ABCDEF", 3.0),
    ("entropy_lower", "abcdefghijklmnopqrstuvwxyz0123456789", 3.6),
    ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.9),
]
#: Windows that overlap one of these are no secrets: placeholders, runs of the alphabet, UUIDs, example keys.
ALLOWED = [r"(?i)example|placeholder|changeme|redacted|dummy", r"(?i)0123456789|abcdefghij|(.)\1{5,}", r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"]


def _class_pattern(alphabet: str) -> str:
    inside = "".join("\\" + c if c in "+/_-" else c for c in alphabet)
    return f"[{inside}]{{{WINDOW},}}"


#: Bits of one count in a packed number, and counts in one number. A count is a window's length at most.
BITS, PACKED = 5, 12


def dense(candidate: Column, alphabet: Column, bits: Column, window: int = WINDOW) -> Column:
    """struct(lo, hi): from the first to the end of the last window whose entropy reaches bits (lo null if none).

    One fold over the characters (split once) keeps their counts in the window, packed into a few numbers, and the sum
    of c*log2(c); a step adds one character and drops the one that leaves: two counts and two terms of the sum change,
    whatever the length of the candidate.
    """
    if window >= 1 << BITS:
        raise ValueError(f"a window has less than {1 << BITS} characters")
    term = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), F.ceil(F.char_length(alphabet) / PACKED).cast("int")).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
    row = lambda k: F.floor(k / PACKED).cast("int")
    unit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), (k % PACKED) * BITS)
    count = lambda counts, k: F.call_function("shiftright", F.get(counts, row(k)), (k % PACKED) * BITS) % (1 << BITS)

    def step(s: Column, x: Column) -> Column:
        here, gone = x["here"], x["gone"]
        gone_count = F.when(gone >= 0, count(s["counts"], gone))
        here_count = count(s["counts"], here) - F.when(gone == here, 1).otherwise(0)
        total = s["sum"] - F.coalesce(term(gone_count) - term(gone_count - 1), F.lit(0.0)) + term(here_count + 1) - term(here_count)
        changed = F.transform(s["counts"], lambda c, j: c + F.when(j == row(here), unit(here)).otherwise(0) - F.when((gone >= 0) & (j == row(gone)), unit(gone)).otherwise(0))
        i = s["i"] + 1
        hot = (i >= window) & (F.lit(float(window)) * (F.log2(F.lit(float(window))) - bits) + 1e-9 >= total)
        return F.struct(changed.alias("counts"), total.alias("sum"), i.alias("i"), F.when(s["lo"].isNull() & hot, i - window).otherwise(s["lo"]).alias("lo"), F.when(hot, i).otherwise(s["hi"]).alias("hi"))

    def walk(codes: Column) -> Column:
        leaving = F.concat(F.array_repeat(F.lit(-1), window), codes)
        both = F.zip_with(codes, F.slice(leaving, F.lit(1), F.size(codes)), lambda here, gone: F.struct(here.alias("here"), gone.alias("gone")))
        return F.aggregate(both, zero, step, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))

    return let(F.transform(F.split(candidate, ""), lambda c: F.instr(alphabet, c) - 1), walk)


def _between(s: Column, allow: str, window: int) -> Column:
    """The pieces of a found span between matches of the allow-list, where a window has room."""
    wide = F.filter(placed(alternate(s["found"], allow), s["start"]), lambda x: F.char_length(x["gap"]) >= window)
    return F.transform(wide, lambda x: F.struct(x["at"].alias("start"), (x["at"] + F.char_length(x["gap"])).alias("end"), x["gap"].alias("found")))


def _listed(kind: Column, rank: Column, found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), kind.alias("kind")))


def scan(docs: DataFrame, window: int = WINDOW, classes: list[tuple[str, str, float]] | None = None, allowed: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id and the arrays assign, access, hex (base) and added (entropy), each of structs
    start, rank, end, kind. Added spans lie in no base span of the same document and overlap nothing of the allow-list.
    Null and empty texts have no spans; positions are code points. Rows are scanned one by one: repeated ids, null ids
    and repeated rows each have a row of their own; an empty table gives none; other columns are not looked at."""
    allow = "|".join(f"(?:{a})" for a in (ALLOWED if allowed is None else allowed))
    text = F.col("text")
    kinds = {
        "assign": _listed(F.lit("assign"), F.lit(0), F.filter(spans(text, ASSIGN), lambda s: F.char_length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 6)),
        "access": _listed(F.lit("access"), F.lit(1), F.filter(spans(text, ACCESS), lambda s: F.char_length(s["found"]) >= 20)),
        "hex": _listed(F.lit("hex"), F.lit(2), spans(text, "[0-9a-f]{24,}")),
    }

    every = list(enumerate(classes or CLASSES, 3))
    widest = _class_pattern("".join(sorted(set("".join(alphabet for _, (_, alphabet, _) in every)))))
    listed = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), F.lit(alphabet).alias("alphabet"), F.lit(_class_pattern(alphabet)).alias("pattern"), F.lit(bits).alias("bits")) for rank, (kind, alphabet, bits) in every))

    def inner(pattern: Column) -> Column:
        """The runs of one class. Each lies within one run of all classes' characters, of which texts have few."""
        moved = lambda r: F.transform(spans(r["found"], pattern), lambda s: F.struct((r["start"] + s["start"]).alias("start"), (r["start"] + s["end"]).alias("end"), s["found"].alias("found")))
        return F.flatten(F.transform("runs", moved))

    def dense_spans(c: Column) -> Column:
        found = inner(c["pattern"])
        candidates = F.flatten(F.transform(found, lambda s: F.when(s["found"].rlike(allow), _between(s, allow, window)).otherwise(F.array(s)))) if allow else found
        rated = F.transform(candidates, lambda s: F.struct(s["start"].alias("at"), dense(s["found"], c["alphabet"], c["bits"], window).alias("d")))
        hot = F.filter(rated, lambda s: s["d"]["lo"].isNotNull())
        return _listed(c["kind"], c["rank"], F.transform(hot, lambda s: F.struct((s["at"] + s["d"]["lo"]).alias("start"), (s["at"] + s["d"]["hi"]).alias("end"))))

    # one expression for all classes: five of these take Spark longer to analyse than to run
    added = F.when(F.size("runs") > 0, F.flatten(F.transform(listed, dense_spans))).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))
    # bound as lambda variables: the optimizer may copy a column's expression to where it is used, here into a loop
    covered = lambda base: F.filter(added, lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    own = lambda f: [f[k].alias(k) for k in kinds]
    found = let(F.struct(*(c.alias(k) for k, c in kinds.items())), lambda f: let(F.array_sort(F.concat(*(f[k] for k in kinds))), lambda base: F.struct(*own(f), base.alias("base"), covered(base).alias("added"))))
    rows = texts(docs).select("doc_id", "text", spans(text, widest).alias("runs"))
    return rows.select("doc_id", found.alias("found")).select("doc_id", "found.*")


def joined(spans_: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans_), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
