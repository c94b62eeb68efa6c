r"""Secret scans in SQL expressions only: fixed patterns, and sliding-window entropy for the rest.

Base kinds, leftmost and non-overlapping per kind: ``assign`` (a password-like
name, ``:`` or ``=``, a value of 6 characters or more), ``access`` (AKIA keys of
20 characters or more) and ``hex`` (lower-case hex runs of 24 or more).

Entropy kinds: a candidate string is a maximal run of 20 or more characters of
``A-Za-z0-9+/_-`` that is not on the allow-list; words are on it, but not jumbled
letters, which change case too often to be words and are not camel case either.
Its class is ``hexclass`` (hex digits only), ``alnum`` (letters and digits only)
or ``token`` (anything else). A window of WINDOW characters slides over it; the
Shannon entropy of the window comes from counts that change by the one
character that enters and the one that leaves. The candidate is reported, whole,
if any window reaches the class's threshold, or as ``token`` if a separator-free
part of WINDOW or more characters would be reported by its own class. Spans that a base span covers are
not reported twice.

Defined results: a null or empty text has no spans; repeated rows are scanned
each; an empty table gives no rows; other columns are not read, but ``scan_secrets``
refuses a table that has columns with the names of its own (ValueError).
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, text_or_empty

#: The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "hexclass", "alnum", "token")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
#: Bits a character that one window must reach, by class. A window of 20 has 4.32 at most, of hex digits 4.0.
THRESHOLDS = {"hexclass": 3.1, "alnum": 3.6, "token": 3.7}
#: Not secrets: UUIDs; dates and numbers with separators.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_-]+$",
)
#: Not secrets unless their letters are jumbled: words and paths of words; such with a trailing number of four digits at most.
WORDS = (r"^[A-Za-z+/_-]+$", r"^[A-Za-z/_-]*[A-Za-z][0-9]{1,4}$")
#: Neither are slugs: parts between separators, each of letters only or of four digits at most. No pattern here repeats
#: a group: Java's matcher recurses once a repetition, and a long candidate would end its stack.
SLUG = r"^[A-Za-z0-9](?:[A-Za-z0-9/_-]*[A-Za-z0-9])?$"
NO_SLUG = r"[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{5}"
CASE_CHANGE = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
#: Characters of a candidate that one run of the sliding window covers; runs overlap by all but one of the window.
RUN = 256
#: Matches whose places are summed up together.
SPAN_BLOCK = 128
#: Share of neighbouring characters that differ in case, from which letters with two capitals in a row are jumbled. At random it is 0.5.
JUMBLED = 0.3


def _spans(text: Column, pattern: str, kind: str, keep_group: int | None = None) -> Column:
    """Matches of ``pattern`` as array<struct<start,end,rank,kind>>, in code points; of ``keep_group``, 6 characters are needed."""
    rank = KINDS.index(kind)

    def positions(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(keep_group)) if keep_group else found
        items = F.zip_with(F.zip_with(found, values, lambda m, v: F.struct(F.length(m).alias("n"), (F.length(v) >= 6).alias("ok"))), gaps,
                           lambda m, g: F.struct(m["n"].alias("n"), m["ok"].alias("ok"), F.length(g).alias("gap")))
        # the last gap has no match: its length is null and is left out
        return once(F.filter(items, lambda x: x["n"].isNotNull()), placed)

    def block_spans(block: Column, begin: Column) -> Column:
        zero = F.struct(begin.alias("at"), F.array().cast(_SPANS).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + x["n"]
            one = F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))
            return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, zero, step, lambda acc: acc["out"])

    def placed(items: Column) -> Column:
        """Blocks first get the place where they begin, so that no step copies all spans so far."""
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / SPAN_BLOCK)), lambda b: F.slice(items, (b * SPAN_BLOCK + 1).cast("int"), SPAN_BLOCK))

        def spans(blocks: Column) -> Column:
            sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x["gap"] + x["n"]))
            begins = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
            return F.flatten(F.zip_with(blocks, F.slice(begins, F.lit(1), F.size(blocks)), block_spans))

        return F.when(F.size(items) == 0, F.array().cast(_SPANS)).otherwise(once(blocks, spans))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.regexp_like(text, F.lit(pattern)), once(found, positions)).otherwise(F.array().cast(_SPANS))


_SPANS = "array<struct<start:int,end:int,rank:int,kind:string>>"


def peak_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits a character, of any window of ``candidate``."""
    terms = F.array(F.lit(0.0), *[F.lit(c * log2(c)) for c in range(1, window + 1)])

    def coded(chars: Column) -> Column:
        """A character is its place among the distinct ones, so that the counts are as few as these."""
        return once(F.array_distinct(chars), lambda names: once(F.transform(chars, lambda c: F.array_position(names, c).cast("int") - 1), lambda seq: slide(seq, F.size(names))))

    def slide(seq: Column, size: Column) -> Column:
        zero = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("total"), F.lit(1e9).alias("least"))

        def step(acc: Column, i: Column) -> Column:
            entering = F.get(seq, i)
            leaving = F.coalesce(F.when(i >= window, F.get(seq, i - F.lit(window))), F.lit(-1))
            c_in = F.get(acc["counts"], entering)
            c_out = F.coalesce(F.get(acc["counts"], F.when(leaving >= 0, leaving)), F.lit(0))
            same = entering == leaving
            change = F.get(terms, c_in + 1) - F.get(terms, c_in) + F.when(leaving >= 0, F.get(terms, c_out - 1) - F.get(terms, c_out)).otherwise(0.0)
            counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == entering, 1).otherwise(0) - F.when(k == leaving, 1).otherwise(0))
            total = F.when(same, acc["total"]).otherwise(acc["total"] + change)
            full = i >= F.lit(window - 1)
            return F.struct(
                F.when(same, acc["counts"]).otherwise(counts).alias("counts"), total.alias("total"),
                F.when(full, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"),
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(seq) - 1), zero, step, lambda acc: F.lit(log2(window)) - acc["least"] / F.lit(float(window)))

    return F.when(F.length(candidate) >= window, once(F.split(candidate, ""), coded)).otherwise(F.lit(0.0))


def reaches(candidate: Column, least: Column) -> Column:
    """Whether any window of ``candidate`` has ``least`` bits a character. Runs of windows are looked at until one has.

    Of n distinct characters no window has more than log2(n) bits: runs with too few are passed over.
    """
    last = F.greatest(F.ceil((F.length(candidate) - WINDOW + 1) / (RUN - WINDOW + 1)) - 1, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.substring(candidate, (i * (RUN - WINDOW + 1) + 1).cast("int"), F.lit(RUN)))
    enough = lambda run: F.log2(F.size(F.array_distinct(F.split(run, "")))) >= least - F.lit(1e-9)
    return F.exists(runs, lambda run: enough(run) & (peak_entropy(run) >= least))


def _entropy_spans(text: Column) -> Column:
    spans = _spans(text, CANDIDATE, "token")

    def kind_of(s: Column) -> Column:
        return F.when(F.regexp_like(s, F.lit("^[0-9a-fA-F]+$")), "hexclass").when(F.regexp_like(s, F.lit("^[A-Za-z0-9]+$")), "alnum").otherwise("token")

    def suspicious(s: Column) -> Column:
        kind = kind_of(s)
        least = F.when(kind == "hexclass", THRESHOLDS["hexclass"]).when(kind == "alnum", THRESHOLDS["alnum"]).otherwise(THRESHOLDS["token"])
        jumbled = F.regexp_like(s, F.lit("[A-Z]{2}")) & (F.regexp_count(s, F.lit(CASE_CHANGE)) >= F.lit(JUMBLED) * (F.length(s) - 1))
        slug = F.regexp_like(s, F.lit(SLUG)) & ~F.regexp_like(s, F.lit(NO_SLUG))
        words = (F.regexp_like(s, F.lit("|".join(WORDS))) | slug) & ~jumbled
        return ~F.regexp_like(s, F.lit("|".join(ALLOW))) & ~words & reaches(s, least)

    def judge(span: Column, string: Column) -> Column:
        parts = F.filter(F.split(string, "[+/_-]"), lambda p: (F.length(p) >= WINDOW) & (F.length(p) < F.length(string)))
        kind = kind_of(string)
        rank = F.when(kind == "hexclass", KINDS.index("hexclass")).when(kind == "alnum", KINDS.index("alnum")).otherwise(KINDS.index("token"))
        hit = suspicious(string) | F.exists(parts, suspicious)
        return F.when(hit, F.struct(span["start"].alias("start"), span["end"].alias("end"), rank.alias("rank"), kind.alias("kind")))

    # most texts have no run that long with a digit or two capitals; those skip everything else
    some = F.regexp_like(text, F.lit(r"[0-9]|[A-Z]{2}")) & F.regexp_like(text, F.lit(CANDIDATE))
    judged = F.zip_with(spans, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), judge)
    return F.when(some, F.filter(judged, lambda s: s.isNotNull())).otherwise(F.array().cast(_SPANS))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with arrays of spans: ``base_spans`` and ``all_spans`` (start, rank, end, kind; code points, end exclusive)."""
    clash = {"base_spans", "all_spans"} & set(docs.columns)
    if clash:
        raise ValueError(f"the input has columns {sorted(clash)} already")
    body = text_or_empty(text)
    base = F.concat(_spans(body, ASSIGN, "assign", 2), _spans(body, ACCESS, "access"), _spans(body, HEX, "hex"))
    docs = docs.withColumn("base_spans", _ordered(base))
    extra = F.filter(
        _entropy_spans(body),
        lambda s: ~F.exists("base_spans", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])),
    )
    return docs.withColumn("all_spans", _ordered(F.concat(F.transform("base_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind"))), extra)))


def secret_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, and all spans as a string."""
    found = scan_secrets(docs.select(F.col(key).alias(key), F.col(text).alias(text)), text)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        key,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
        _joined(F.col("all_spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]", length: str | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``, columns as they were; overlapping spans are replaced as one.

    ``length`` names a column that then counts the new text's code points. A null text stays null, and its length as it was.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    found = scan_secrets(rows, "text")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    found = found.withColumn("clean", F.when(F.size("all_spans") == 0, F.col("text")).otherwise(F.aggregate("all_spans", zero, step, rest)))
    new = {text: F.col("clean")}
    if length:
        old = F.col("row")[length]
        new[length] = F.when(F.col("text").isNull(), old).otherwise(F.length("clean").cast(docs.schema[length].dataType))
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
