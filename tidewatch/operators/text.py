"""Text, logs and document checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import signature, strip
from ..sources.findings import parse_findings, walk_json
from ..sources.scratch import release, written
from ..sources.text import explode_lines, extract_frontmatter

# Fixed values of the document checks.
REQUIRED_KEYS = ("name", "description", "risk", "loop-tier")
RISKS = ("read-only", "generates-code", "write-confirm")
TIERS = ("on-demand", "retry-until-resolved", "scheduled-notify-only", "pattern-gated-auto-remediation", "system-loop")
FINDING_KEYS = ("evidence", "recommendation", "severity")
SNIPPET = 120
#: Heads from which a shingle comes behind the others, the most such shingles (only the order depends on them), and marks that are broadcast.
LATE_TEXTS, MOST_LATE, MARKS = 64, 1 << 11, 1 << 21
#: Shingles of a block of sets that are compared together, and those that a set counts for besides its own.
BLOCK_SHINGLES, MEMBER_SHINGLES = 1 << 20, 1 << 10


@dataclass(frozen=True)
class Rule:
    """A line rule: at most one violation for each line, or one for each match; lines with an exempt text are spared."""

    rule_id: str
    pattern: str
    each: bool = False
    exempt: str = ""


#: Patterns of the portability check (fixed values).
PORTABILITY = (
    Rule("assistant-claude-code", r"(?i)\bClaude Code\b"),
    Rule("assistant-mcp", r"(?i)\bmcp\b|\bmcp[-_]server\b"),
    Rule("assistant-cursor", r"\bCursor\b"),
    Rule("assistant-copilot", r"(?i)\bCopilot\b"),
    Rule("assistant-codex", r"(?i)\bCodex\b"),
    Rule("slash-command", r"`/[a-z][a-z0-9]*(?:-[a-z0-9]+)+`"),
    Rule("bare-script-path", r"`(?:\./)?scripts/[^`]+`", each=True),
    Rule("drive-letter", r"\b[A-Za-z]:\\", exempt=r"path\\to|path/to|<"),
)


def required_keys(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Frontmatter check: missing block, missing keys (sorted), values outside risk and tier; one row for each problem."""
    front = extract_frontmatter(docs, key, text).select(key, "frontmatter")
    missing = F.array_sort(F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), F.map_keys("frontmatter")))
    value = lambda k: F.try_element_at("frontmatter", F.lit(k))
    problems = F.array(
        F.when(F.col("frontmatter").isNull(), "no frontmatter"),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
        F.when(~value("risk").isin(*RISKS), F.concat(F.lit("risk: "), value("risk"))),
        F.when(~value("loop-tier").isin(*TIERS), F.concat(F.lit("loop-tier: "), value("loop-tier"))),
    )
    return front.select(key, F.explode(F.array_compact(problems)).alias("problem"))


def check_findings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Finding check: malformed JSON, missing keys, else empty evidence; one row for each problem.

    A finding is an object with ``issue`` or ``recommendation``, at any level.
    Evidence is empty if it is null, false, 0, "", [] or {}.
    """
    parsed = parse_findings(docs, key, text)
    broken = parsed.where("malformed").select(key, F.lit("root").alias("path"), F.lit("malformed").alias("problem"))
    objects = walk_json(parsed, key)
    keys = F.map_keys(F.try_variant_get("value", "$", "map<string,variant>"))
    found = objects.withColumn("keys", keys).where(F.array_contains("keys", "issue") | F.array_contains("keys", "recommendation"))
    missing = F.filter(F.array(*[F.lit(k) for k in FINDING_KEYS]), lambda k: ~F.array_contains("keys", k))
    empty = F.coalesce(F.to_json(F.try_variant_get("value", "$.evidence", "variant")), F.lit("null")).isin("null", "false", "0", '""', "[]", "{}")
    problem = F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))).when(empty, "empty evidence")
    return broken.unionByName(found.select(key, "path", problem.alias("problem")).where("problem IS NOT NULL"))


def lint_corpus(docs: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = PORTABILITY) -> DataFrame:
    """Violations of line rules in document bodies: key, line_no (of the file), rule_id, snippet."""
    body = extract_frontmatter(docs, key, text)
    offset = body.select(key, "body_start_line", F.col("body").alias("text"))
    lined = explode_lines(offset.withColumn("k", F.struct(key, "body_start_line")), "k", "text")
    lined = lined.select(F.col(f"k.{key}").alias(key), (F.col("line_no") + F.col("k.body_start_line") - 1).alias("line_no"), "line")

    def times(rule: Rule) -> Column:
        n = F.regexp_count("line", F.lit(rule.pattern)) if rule.each else F.col("line").rlike(rule.pattern).cast("int")
        return F.when(~F.col("line").rlike(rule.exempt), n).otherwise(0) if rule.exempt else n

    # one alternation first: most lines match no rule and are read once
    lined = lined.where(F.col("line").rlike("|".join(f"(?:{r.pattern})" for r in rules)))
    hits = F.flatten(F.array(*[F.array_repeat(F.lit(r.rule_id), times(r)) for r in rules]))
    return lined.select(key, "line_no", F.explode(hits).alias("rule_id"), F.substring(strip(F.col("line")), 1, SNIPPET).alias("snippet"))


SECRETS = (("hex-token", r"[0-9a-f]{40}"), ("assigned-token", r"(?i)(?:token|secret|password|api_key) *[=:] *\"[^\"]{8,}\""))


def secrets_scan(docs: DataFrame, key: str, text: str, rules: tuple[tuple[str, str], ...] = SECRETS) -> DataFrame:
    """Credential-like spans: rule, line and the masked span (first four characters only)."""
    lined = explode_lines(docs, key, text)

    def spans_of(rule: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(rule).alias("rule_id"), m.alias("span")))

    found = F.flatten(F.array(*[spans_of(r, p) for r, p in rules]))
    spans = lined.select(key, "line_no", F.inline(found))
    return spans.select(key, "line_no", "rule_id", F.concat(F.substring("span", 1, 4), F.lit("****")).alias("masked"), F.length("span").alias("span_length"))


def prefilter_log(lines: DataFrame, log: str, noise: str, fail: str, cap: int, context: int = 0) -> DataFrame:
    """The last ``cap`` lines of each log from ``context`` lines before its first failure on, noise left out, with the numbers suppressed and of noise.

    Logs without a failure give no row.
    """
    own = Window.partitionBy(log)
    marked = lines.withColumn("is_noise", F.col("line").rlike(noise)).withColumn("from_line", F.min(F.when(F.col("line").rlike(fail), F.col("line_no"))).over(own))
    block = marked.where(~F.col("is_noise") & (F.col("line_no") >= F.col("from_line") - context))
    ranked = block.withColumn("back", F.row_number().over(own.orderBy(F.desc("line_no")))).where(F.col("back") <= cap).drop("back")
    total = lines.groupBy(log).agg(F.count("*").alias("total"), F.count_if(F.col("line").rlike(noise)).alias("noise"))
    kept = ranked.groupBy(log).agg(F.count("*").alias("kept"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    return kept.join(total, log).select(log, "kept", "first_line", "last_line", (F.col("total") - F.col("kept")).alias("suppressed"), "noise")


def root_cause(lines: DataFrame, key: str, rules: list[tuple[str, str]]) -> DataFrame:
    """The first category, in the order of the rules, that some line of a log matches; else 'unknown'."""
    order = F.least(*[F.when(F.col("line").rlike(p), F.lit(i)) for i, (_, p) in enumerate(rules)], F.lit(len(rules)))
    names = F.array(*[F.lit(n) for n, _ in rules], F.lit("unknown"))
    return lines.groupBy(key).agg(F.min(order).alias("o")).select(key, F.element_at(names, F.col("o") + 1).alias("category"))


def error_diff(lines: DataFrame, split: Column, line: str = "line", horizon: Column | None = None) -> DataFrame:
    """Signatures before and after ``split`` (true: after), by what happened to them: new, gone, grown, shrunk.

    With ``horizon`` only lines for which it is true count, such as those of the last two days.
    """
    lines = lines if horizon is None else lines.where(horizon)
    counts = lines.groupBy(signature(F.col(line)).alias("signature")).agg(F.count_if(~split).alias("before"), F.count_if(split).alias("after"))
    change = F.when(F.col("before") == 0, "new").when(F.col("after") == 0, "gone").when(F.col("after") > F.col("before"), "grown").when(F.col("after") < F.col("before"), "shrunk")
    return counts.withColumn("change", change).where("change IS NOT NULL")


def _shingled(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """key, s: the distinct word shingles of each text that has words, with what tells a set of them: 128 bits over it (s0, s1) and its size n."""
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    n = F.size("t")
    shingle = F.when(n >= words, F.transform(F.sequence(F.lit(1), F.greatest(n - words + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("t", i, words), " ")))).otherwise(F.array(F.xxhash64(F.array_join("t", " "))))
    found = df.where(F.col(text).isNotNull()).select(key, tokens.alias("t")).where("size(t) > 0").select(key, F.array_sort(F.array_distinct(shingle)).alias("s"))
    return written(found.select(key, "s", *_same_set()), "l7-shingles")


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """All pairs of different definitions whose word shingles have a Jaccard similarity of ``threshold`` or more.

    Texts with equal shingles are reduced to one representative (the smallest
    key) first, so copies never meet each other; ``representatives`` names them.
    Sets are equal if 128 bits over them and their sizes are. Candidates are exact: with shingles in one order for
    all, by hash, but those that many such heads hold last, a similar pair has a shingle in common among the first of
    each, and neither size nor the places behind that shingle rule it out; nor do sketches of a bit or two for each shingle,
    which bound the shingles that one of both has alone. So a fifth of the shingles is shuffled, and whole sets only of texts in
    such pairs: to the few blocks of texts near each other that its own one meets, not to each of its pairs.
    """
    shingled = _shingled(df, key, text, words)
    return _similar(shingled, written(_named(shingled, key), "l7-named"), key, threshold)


def _similar(shingled: DataFrame, named: DataFrame, key: str, threshold: float) -> DataFrame:
    """The pairs; ``shingled`` is deleted."""
    docs = _first_only(shingled, named, key)
    # a little below the threshold, so that rounding loses no pair; the similarity itself decides
    t = F.lit(threshold - 1e-9)
    first = lambda o: F.slice(o, F.lit(1), F.size(o) - F.ceil(t * F.size(o)).cast("int") + 1)
    often = docs.select(F.explode(first("s")).alias("x")).groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") > LATE_TEXTS)
    often = written(often.orderBy(F.desc("n"), "x").limit(MOST_LATE), "l7-late")
    late = often.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda e: e["x"]).alias("late"))
    ordered = docs.crossJoin(F.broadcast(late)).select(key, F.concat(F.array_except("s", "late"), F.array_intersect("late", "s")).alias("o"))
    heads = ordered.select(F.col(key).alias("k"), F.size("o").alias("size"), F.posexplode(first("o")).alias("at", "x"))
    a, b = heads.alias("a"), heads.alias("b")
    behind = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    able = (F.least("a.size", "b.size") >= t * F.greatest("a.size", "b.size")) & (behind >= t / (1 + t) * (F.col("a.size") + F.col("b.size")))
    pairs = a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.k") < F.col("b.k")) & able).select(F.col("a.k").alias("a"), F.col("b.k").alias("b")).distinct()
    pairs = written(pairs, "l7-pairs")
    release(often)
    kind = pairs.schema["a"].dataType.simpleString()
    sizes, sets = named.select(F.col(key).alias("node"), "n"), docs.select(F.col(key).alias("node"), "s")
    met = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "l7-met")
    few = met.count() <= MARKS  # else sketches are shuffled, which are smaller than sets
    sketches = (sets.join(F.broadcast(met), "node", "left_semi") if few else sets).mapInArrow(_sketched, f"node {kind}, n long, bits binary")
    sketches = written(sketches if few else sketches.join(met, "node", "left_semi"), "l7-sketches")
    most = (1 - threshold + 1e-9) / (1 + threshold - 1e-9)
    near = _in_blocks(pairs, sketches, sizes, 64, lambda p, m: _near(p, m, most), f"a {kind}, b {kind}")
    release(pairs, met, sketches)
    found = _in_blocks(near, sets, sizes, 1, _common, f"a {kind}, b {kind}, common long, total long")
    release(near, docs, shingled)
    similarity = F.col("common") / (F.col("total") - F.col("common"))
    return found.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold).select("a", "b", F.round("similarity", 6).alias("similarity"))


def _first_only(shingled: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """The representatives' sets: told by their own keys or by those of the copies, whichever are fewer, so that the sets stay where they are."""
    copy = F.col(key) != F.col("representative")
    copies, firsts = named.agg(F.count_if(copy), F.count_if(~copy)).first()
    if min(copies, firsts) > MARKS:
        return written(shingled.join(named.where(~copy).select(key), key, "left_semi"), "l7-firsts")
    marks = F.broadcast(named.where(copy if copies <= firsts else ~copy).select(key))
    return shingled.join(marks, key, "left_anti" if copies <= firsts else "left_semi")


def _in_blocks(pairs: DataFrame, members: DataFrame, sizes: DataFrame, share: int, compared: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``compared`` returns for the pairs of a block and the members they name, of all blocks. ``share``: the part of a set that a member is.

    Texts are put into blocks by the smallest text within two steps of their pairs, which a crowd of near copies shares; small crowds
    share a block, a large one has several. A member goes to each pair of blocks that one of its pairs lies in, not to each of its pairs.
    """
    sides = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = written(sides.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("lead")), "l7-near")
    far = sides.join(_small(near.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("lead").alias("far"))
    leads = near.join(far, "node").select("node", F.least("lead", "far").alias("lead"))
    leads = written(leads.join(sizes, "node").select("node", "lead", (F.ceil(F.col("n") / share) + MEMBER_SHINGLES).alias("weight")), "l7-leads")
    blocks = -(-(leads.agg(F.sum("weight")).first()[0] or 1) // BLOCK_SHINGLES)
    parts = F.ceil(F.col("of_lead") / BLOCK_SHINGLES)
    block = F.when(parts > 1, F.xxhash64("lead", F.pmod(F.xxhash64("node"), parts))).otherwise(F.pmod(F.xxhash64("lead"), F.lit(blocks)))
    chosen = leads.join(leads.groupBy("lead").agg(F.sum("weight").alias("of_lead")), "lead").select("node", block.alias("block"))
    chosen = written(chosen, "l7-blocks")
    of = lambda name: _small(chosen.select(F.col("node").alias(name), F.col("block").alias(f"of_{name}")))
    placed = pairs.join(of("a"), "a").join(of("b"), "b").select(F.least("of_a", "of_b").alias("p"), F.greatest("of_a", "of_b").alias("q"), "a", "b")
    placed = written(placed, "l7-placed")
    sent = written(placed.select("p", "q", F.explode(F.array("a", "b")).alias("node")).distinct(), "l7-sent")
    out = placed.groupBy("p", "q").cogroup(members.join(_small(sent), "node").groupBy("p", "q")).applyInArrow(compared, schema)
    out = written(out, "l7-compared")
    release(near, leads, chosen, placed, sent)
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, size and a bit for each place that an odd number of its shingles falls on; as many places as shingles or up to twice that."""
    for batch in batches:
        lists, out = batch.column("s"), []
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        for own in np.split(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)[:-1]):
            places = 1 << max(6, int(len(own) - 1).bit_length())
            out.append(np.packbits((np.bincount(own & (places - 1), minlength=places) & 1).astype(np.uint8), bitorder="little").tobytes())
        if out:
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "n": sizes, "bits": pa.array(out, pa.binary())})


def _near(pairs: pa.Table, members: pa.Table, most: float) -> pa.Table:
    """The pairs that may be similar: places that differ are no more than shingles that one set has alone, which are at most ``most`` of both sets."""
    n, nodes = members.column("n").to_numpy(), members.column("node").combine_chunks()
    bits = members.column("bits").to_pylist()
    a, b = (pc.index_in(pairs.column(c), value_set=nodes).to_numpy().astype(np.int64) for c in ("a", "b"))
    width = np.array([len(x) for x in bits], np.int64)
    stays = np.zeros(len(a), bool)
    both = np.minimum(width[a], width[b])
    for w in np.unique(both):
        at = np.flatnonzero(both == w)
        used = np.unique(np.concatenate([a[at], b[at]]))
        # more places are folded: two of them become one, which is odd if one of both is
        rows = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[i], np.uint8).reshape(-1, w), axis=0) for i in used])
        for k in range(0, len(at), step := max(1, (1 << 24) // w)):
            i = at[k : k + step]
            differ = np.bitwise_count(rows[np.searchsorted(used, a[i])] ^ rows[np.searchsorted(used, b[i])]).sum(axis=1, dtype=np.int64)
            stays[i] = differ <= most * (n[a[i]] + n[b[i]])
    return pairs.select(["a", "b"]).filter(pa.array(stays))


def _common(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The shingles in common of each pair of a block: numbered once, then marked for one text and looked up for all that it meets."""
    lists = sets.column("s").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    ids = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
    nodes = sets.column("node").combine_chunks()
    pairs = pairs.select(["a", "b"]).sort_by("a")
    a, b = (pc.index_in(pairs.column(c), value_set=nodes).to_numpy().astype(np.int64) for c in ("a", "b"))
    common, marked = np.zeros(len(a), np.int64), np.zeros(len(ids), np.int64)
    starts = np.flatnonzero(np.diff(a, prepend=-1))
    for i, j in zip(starts, [*starts[1:], len(a)]):
        own = ids[ends[a[i]] - sizes[a[i]] : ends[a[i]]]
        marked[own] = 1
        for k in range(i, j, 1024):
            met = b[k : min(j, k + 1024)]
            begins = np.cumsum(sizes[met]) - sizes[met]
            at = np.arange(sizes[met].sum()) + np.repeat(ends[met] - sizes[met] - begins, sizes[met])
            common[k : k + len(met)] = np.add.reduceat(marked[ids[at]], begins)
        marked[own] = 0
    return pa.table({"a": pairs.column("a"), "b": pairs.column("b"), "common": common, "total": sizes[a] + sizes[b]})


def _same_set() -> list[Column]:
    """What tells a set of shingles: 128 bits over it, and its size."""
    return [F.xxhash64("s").alias("s0"), F.xxhash64(F.lit(1), "s").alias("s1"), F.size("s").alias("n")]


def _small(marks: DataFrame) -> DataFrame:
    """Marks of a few longs are broadcast up to ``MARKS``, so that what they choose from stays where it is."""
    return F.broadcast(marks) if marks.count() <= MARKS else marks


def representatives(df: DataFrame, key: str, text: str, words: int = 5) -> DataFrame:
    """(key, representative) for every text with words: the smallest key with the same shingles, by which ``near_duplicates`` names it."""
    return _named(_shingled(df, key, text, words), key).select(key, "representative")


def _named(shingled: DataFrame, key: str) -> DataFrame:
    told = shingled.select(key, "s0", "s1", "n")
    return told.join(told.groupBy("s0", "s1", "n").agg(F.min(key).alias("representative")), ["s0", "s1", "n"]).select(key, "n", "representative")


def near_duplicates_of_all(df: DataFrame, key: str, text: str, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """The pairs of ``near_duplicates``, and each other text of equal shingles with its representative (a) at similarity 1."""
    shingled = _shingled(df, key, text, words)
    named = written(_named(shingled, key), "l7-named")
    stars = named.where(F.col(key) != F.col("representative")).select(F.col("representative").alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("similarity"))
    return _similar(shingled, named, key, threshold).unionByName(stars)


def complexity(df: DataFrame, key: str, text: str) -> DataFrame:
    """Length, deepest bracket nesting and number of calls of an expression text."""
    chars = F.filter(F.split(text, ""), lambda c: c.isin("(", ")", "{", "}", "<", ">"))
    step = lambda acc, c: F.struct((acc["d"] + F.when(c.isin("(", "{", "<"), 1).otherwise(-1)).alias("d"), F.greatest(acc["m"], acc["d"] + F.when(c.isin("(", "{", "<"), 1).otherwise(-1)).alias("m"))
    depth = F.aggregate(chars, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step, lambda a: a["m"])
    return df.select(key, F.length(text).alias("length"), depth.alias("depth"), F.regexp_count(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*\(")).alias("calls"))


def attrs(df: DataFrame, key: str, json: str, schema: str) -> DataFrame:
    """Typed fields of a JSON attribute; malformed text gives nulls."""
    return df.select(key, F.from_json(json, schema).alias("a")).select(key, "a.*")
