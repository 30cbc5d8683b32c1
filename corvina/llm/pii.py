"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a span classifier decides.

DataFrame functions only, in three readings of a table that has no texts.

* Candidates, found where the text is (one scan, no shuffle): matches of the four base rules, numbers and addresses that look like them (an address with
  spelled-out signs, a telephone number without a country code after a word for telephones), and values after words such as ``token``. Offsets are code points: the text is
  split at the matches, and lengths are summed in blocks, so that time grows with the number of matches and not with its square. Patterns are possessive and
  tied to the ends of runs, so a long run of one class is read once.
* Labelers vote yes (1), no (-1) or nothing (0): the base rule and its checks; a gazetteer of words that stand before (``CUES``, ``COUNTER``); a
  gazetteer of forms (top-level domains, card issuers, calling codes, reserved networks); the characters at both ends; other numbers beside it.
* Reliabilities: candidates are counted by kind and votes (1,215 combinations at most), and expectation-maximisation over these counts runs as a
  fold of ``ROUNDS`` steps in one expression: for each kind, how each labeler votes on what is personal data and on what isn't, and how much of it is. It
  gives each combination its posterior. Beliefs at the start (``RIGHT``) name the classes: the base rule is nearly always right.
* The classifier is a naive Bayes model over hashed features of the span and its surroundings (shape, length, word before, ends, votes), trained
  on all candidates with the posteriors as soft labels. Base spans stay whatever it says; another candidate is added where its probability is
  ``least`` or more and it doesn't overlap a span that is kept before it (base spans first, then by start).

Defined cases: null reads as empty; texts of any length are read whole; repeated rows and null ids are judged row by row; an empty table gives no
rows, and a table without candidates no spans; other columns are ignored, whatever they are called. Ties of the classifier don't matter: it has a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm._base import Scratch

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]

# The base rules. Runs are possessive and begin where a run begins or the match before has ended, which changes no match.
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# End of fixed values.

#: Candidates that no base rule has: spelled-out addresses, national telephone numbers, values of secrets.
SPELLED = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++ ?[(\[{{](?i:at)[)\]}}] ?[{_HOST}]++(?: ?(?:\.|[(\[{{](?i:dot)[)\]}}]) ?[{_HOST}]++)++"
NATIONAL = r"(?<![0-9A-Za-z+(.-])(?<![0-9+)] )\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[ .-][0-9])"
SECRET = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?[a-z0-9_+/.-]{8,}+"
VALUE = r"[A-Za-z0-9_+/.-]+$"

#: Words that speak for a kind and for none, where they stand just before.
CUES = {
    "email": "e-?mail|mail|contact|write|reach|send",
    "ip": "ip|address|host|server|client|login|logged|from",
    "card": "card|visa|mastercard|amex|credit|debit|payment",
    "phone": "tel|phone|telephone|telefon|mobile|mobil|cell|call|fax|whatsapp|sms",
    "secret": "password|passwd|pwd|secret|token|key",
}
COUNTER = "order|invoice|version|release|build|serial|isbn|issn|doi|page|chapter|section|part|no|nr|id|ref|item|sku|article"
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|dev|app|eu|uk|us|de|fr|es|it|sk|cz|pl|at|ch|nl|be|se|no|fi|dk|pt|ru|jp|cn|in|br|au|ca"

B = 128  # a block of the running sums


def running(lens: str) -> str:
    """SQL: running sums of an array of numbers, in two levels."""
    cut = f"slice(l, b * {B} + 1, {B})"
    return f"""transform(array({lens}), l -> if(size(l) = 0, cast(array() as array<bigint>),
      transform(array(transform(sequence(0, (size(l) - 1) div {B}), b -> aggregate({cut}, 0L, (a, x) -> a + x))), sums ->
        flatten(transform(sequence(0, size(sums) - 1), b -> aggregate({cut}, struct(aggregate(slice(sums, 1, b), 0L, (a, x) -> a + x) as at, cast(array() as array<bigint>) as ends),
          (a, x) -> struct(a.at + x as at, array_append(a.ends, a.at + x) as ends), a -> a.ends))))[0]))[0]"""


def matches(pattern: str, guard: str) -> str:
    """SQL: an array of what, left, right, start, stop for each match; none where the guard is false."""
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    none = "cast(array() as array<struct<what: string, left: string, right: string, start: bigint, stop: bigint>>)"
    ends = running("transform(m, (x, i) -> cast(length(x) + length(p[i]) as bigint))")
    return f"""if({guard}, transform(array(regexp_extract_all(t, {p}, 0)), m -> if(size(m) = 0, {none}, transform(array(split(t, {p}, -1)), p ->
      transform(array({ends}), e -> transform(m, (x, i) -> struct(x as what, right(p[i], 48) as left, left(p[i + 1], 16) as right, e[i] - length(x) as start, e[i] as stop)))[0])[0]))[0], {none})"""


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def luhn(x: str) -> str:
    """SQL: whether a string of digits passes the check."""
    return f"""aggregate(sequence(1, length({x})), 0, (a, i) -> a + transform(array(cast(substring({x}, length({x}) + 1 - i, 1) as int) * if(i % 2 = 0, 2, 1)), d -> if(d > 9, d - 9, d))[0]) % 10 = 0"""


#: kind, pattern, a cheap test that a text without a match mostly fails, which matches are candidates, and which of these the base rule keeps.
SOURCES = [
    ("email", EMAIL, "contains(t, '@')", "true", "true"),
    ("ip", IP, "contains(t, '.')", "true", "forall(split(c.what, '[.]'), x -> coalesce(try_cast(x as bigint), 256L) <= 255)"),
    ("card", CARD, "true", f"length({digits('c.what')}) between 13 and 19", luhn(digits("c.what"))),
    ("phone", PHONE, "contains(t, '+')", "true", f"length({digits('c.what')}) between 9 and 15"),
    ("email", SPELLED, "t rlike '(?i)at[)\\\\]}]'", "true", None),
    ("phone", NATIONAL, "true", "after_cue", None),
    ("secret", SECRET, "contains(t, '=') or contains(t, ':')", "true", None),
]


def after_cue(c: str, kind: str) -> str:
    """SQL: whether a word that speaks for the kind stands just before."""
    return f"rlike({c}.left, '(?i)(^|[^a-z])({CUES[kind]})[^a-z0-9]{{0,4}}([a-z]{{1,3}}[^a-z0-9]{{1,3}})?$')"


def candidates() -> Column:
    """Of the column text: an array of kind, base (true or false by a base rule's checks, null for none), what, left, right, start, stop, in the order of SOURCES."""
    each = []
    for kind, pattern, guard, wanted, base in SOURCES:
        found = f"filter({matches(pattern, guard)}, c -> {after_cue('c', kind) if wanted == 'after_cue' else wanted})"
        if kind == "secret":  # the value alone
            found = f"transform({found}, c -> transform(array(regexp_extract(c.what, '{VALUE}', 0)), v -> struct(v as what, concat(c.left, left(c.what, length(c.what) - length(v))) as left, c.right as right, c.stop - length(v) as start, c.stop as stop))[0])"
        each.append(f"transform({found}, c -> struct('{kind}' as kind, {base or 'cast(null as boolean)'} as base, c.what as what, c.left as left, c.right as right, c.start as start, c.stop as stop))")
    return F.expr(f"transform(array(text), t -> concat({', '.join(each)}))[0]")


def votes(c: str) -> str:
    """SQL: the five labelers' votes on the candidate ``c``."""
    cue = " ".join(f"when '{k}' then {after_cue(c, k)}" for k in CUES)
    counter = f"rlike({c}.left, '(?i)(^|[^a-z])({COUNTER})[^a-z0-9]{{0,4}}$')"
    form = f"""case {c}.kind
      when 'email' then rlike({c}.what, '(?i)[.)\\\\]}}] ?({DOMAINS})$')
      when 'ip' then not rlike({c}.what, '^(0|10|127|255|192[.]168)[.]|(^|[.])0[0-9]')
      when 'card' then rlike({digits(f"{c}.what")}, '^(4[0-9]{{15}}|5[1-5][0-9]{{14}}|3[47][0-9]{{13}}|6[0-9]{{15}})$')
      when 'phone' then length({digits(f"{c}.what")}) between 10 and 13
      else length({c}.what) >= 16 and rlike({c}.what, '[0-9]') and rlike({c}.what, '(?i)[a-z]') end"""
    free = f"not rlike({c}.left, '[A-Za-z0-9_@.-]$') and not rlike({c}.right, '^([A-Za-z0-9_@]|[.-][A-Za-z0-9])')"
    beside = f"rlike({c}.left, '[0-9][^A-Za-z0-9]{{1,3}}$') or rlike({c}.right, '^[^A-Za-z0-9]{{1,3}}[0-9]')"
    return f"""array(case when {c}.base then 1 when not {c}.base then -1 else 0 end, case when {counter} then -1 when case {c}.kind {cue} end then 1 else 0 end,
      if({form}, 1, -1), if({free}, 1, -1), if({beside}, -1, 0))"""


BUCKETS = 1 << 14


def features(c: str) -> str:
    """SQL: buckets of the candidate's features; the first is its kind's own, which every candidate of the kind has."""
    shape = f"regexp_replace(regexp_replace(regexp_replace(left({c}.what, 64), '[A-Z]+', 'A'), '[a-z]+', 'a'), '[0-9]+', '9')"
    said = [f"concat('1', {shape})", f"concat('2', least(length({c}.what), 64))", f"concat('3', lower(regexp_extract({c}.left, '([A-Za-z]+)[^A-Za-z0-9]*$', 1)))",
            f"concat('4', right({c}.left, 1), left({c}.right, 1))", f"concat('5', array_join({c}.votes, ','))"]
    return f"transform(array('0', {', '.join(said)}), x -> cast(pmod(xxhash64({c}.kind, x), {BUCKETS}) as int))"


def found(docs: DataFrame) -> DataFrame:
    """doc_id and an array of kind, base, start, stop, votes, features of its candidates: all that is kept of the texts."""
    listed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", candidates().alias("c"))
    voted = f"transform(c, c -> struct(c.kind as kind, c.base as base, c.what as what, c.left as left, c.right as right, c.start as start, c.stop as stop, {votes('c')} as votes))"
    thin = f"transform({voted}, c -> struct(c.kind as kind, c.base as base, c.start as start, c.stop as stop, c.votes as votes, {features('c')} as features))"
    return listed.select("doc_id", F.expr(f"if(size(c) = 0, null, {thin})").alias("spans"))


#: Steps of expectation-maximisation; how often each labeler's vote is taken to be right at the start, and how many candidates that belief counts for.
ROUNDS, RIGHT, BELIEF = 25, (0.98, 0.9, 0.7, 0.6, 0.7), 4
N = len(RIGHT)
#: A place in the tables of vote shares: kind, labeler, vote.
_START = [r / 2 if v == 1 else 0.5 if v == 0 else (1 - r) / 2 for _ in KINDS for r in RIGHT for v in (-1, 0, 1)]


def reliabilities(spans: DataFrame) -> DataFrame:
    """One row, from spans (kind, votes): yes and no, how a labeler votes on what is and what isn't personal data (a share for each kind, labeler and vote), and share, how much of a kind is."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    counted = spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).select(F.expr(f"array_position(array({kinds}), kind) - 1").cast("int").alias("k"), "votes", F.col("n").cast("double").alias("n"))
    one = counted.agg(F.sort_array(F.collect_list(F.struct("k", "votes", "n"))).alias("rows"))  # a row a combination
    at = lambda p: f"aggregate(q, struct({BELIEF}D * x as hit, {BELIEF}D as n), (a, r) -> if(r.k = j div {3 * N}, struct(a.hit + if(r.votes[(j div 3) % {N}] = j % 3 - 1, r.n * {p}, 0D) as hit, a.n + r.n * {p} as n), a), a -> a.hit / a.n)"
    start = lambda flip: "array(" + ", ".join(f"{x}D" for x in (_START if not flip else [_START[j + 2 * (1 - j % 3)] for j in range(len(_START))])) + ")"
    step = f"""transform(array(transform(rows, r -> struct(r.k as k, r.votes as votes, r.n as n, {posterior('s', 'r')} as p))), q -> struct(
      transform({start(False)}, (x, j) -> {at('r.p')}) as yes, transform({start(True)}, (x, j) -> {at('(1 - r.p)')}) as no,
      transform(s.share, (x, k) -> aggregate(q, struct(1D as yes, 2D as n), (a, r) -> if(r.k = k, struct(a.yes + r.n * r.p as yes, a.n + r.n as n), a), a -> a.yes / a.n)) as share))[0]"""
    first = f"struct({start(False)} as yes, {start(True)} as no, array_repeat(0.5D, {len(KINDS)}) as share)"
    return one.select(F.expr(f"aggregate(sequence(1, {ROUNDS}), {first}, (s, i) -> {step})").alias("s")).select("s.*")


def posterior(s: str, r: str) -> str:
    """SQL: the probability that a candidate with the kind r.k and r.votes is personal data, by the model s."""
    at = f"{3 * N} * {r}.k + 3 * l + {r}.votes[l] + 1"
    return f"1 / (1 + exp(-aggregate(sequence(0, {N - 1}), ln({s}.share[{r}.k] / (1 - {s}.share[{r}.k])), (a, l) -> a + ln({s}.yes[{at}] / {s}.no[{at}]))))"


def classifier(spans: DataFrame, model: DataFrame) -> DataFrame:
    """One row, one column: for each bucket the log ratio of its soft counts, in parts of its kind's totals."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    s = model.select(F.struct("yes", "no", "share")).scalar()
    judged = spans.select("kind", "features", F.struct(F.expr(f"array_position(array({kinds}), kind) - 1").cast("int").alias("k"), "votes").alias("r"), s.alias("s"))
    soft = judged.select("kind", "features", F.round(F.expr(posterior("s", "r")) * 1_000_000).cast("long").alias("p"))  # whole numbers: sums don't depend on their order
    totals = F.broadcast(soft.groupBy("kind").agg(F.sum("p").alias("yes_all"), (1_000_000 * F.count(F.lit(1)) - F.sum("p")).alias("no_all")))
    by = soft.select("kind", "p", F.explode("features").alias("b")).groupBy("kind", "b").agg(F.sum("p").alias("yes"), (1_000_000 * F.count(F.lit(1)) - F.sum("p")).alias("no"))
    a = 500_000.0
    ratio = F.log((F.col("yes") + a) / (F.col("yes_all") + 2 * a)) - F.log((F.col("no") + a) / (F.col("no_all") + 2 * a))
    ranked = by.join(totals, "kind").withColumn("w", F.when(F.col("b") == F.expr(f"cast(pmod(xxhash64(kind, '0'), {BUCKETS}) as int)"), F.log((F.col("yes_all") + a) / (F.col("no_all") + a))).otherwise(ratio))
    full = spans.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(ranked.groupBy("b").agg(F.avg("w").alias("w")), "b", "left")
    return full.agg(F.sort_array(F.collect_list(F.struct("b", F.coalesce("w", F.lit(0.0)).alias("w")))).alias("m")).select(F.col("m.w").alias("weights"))


def detect(docs: DataFrame, scratch: Scratch, least: float = 0.9) -> DataFrame:
    """doc_id and spans: an array of kind, start, stop, base and p of each document, by the order of KINDS, then by start."""
    table = scratch.save(found(docs))
    spans = table.select(F.explode("spans").alias("c")).select("c.kind", "c.votes", "c.features")
    model = scratch.save(reliabilities(spans))
    weights = scratch.save(classifier(spans, model)).scalar()
    order = ", ".join(f"'{k}'" for k in KINDS)
    judged = table.where("spans is not null").select("doc_id", F.col("spans").alias("c"), weights.alias("w")).select("doc_id", F.expr("""transform(c, c -> struct(
      c.kind as kind, c.start as start, c.stop as stop, coalesce(c.base, false) as base, 1 / (1 + exp(-aggregate(c.features, 0D, (a, f) -> a + w[f]))) as p))""").alias("c"))
    # what is added is compared with what is kept already, in a document
    kept = judged.select("doc_id", F.expr("filter(c, x -> x.base)").alias("sure"), F.expr(f"array_sort(filter(c, x -> not x.base and x.p >= {least}D), (x, y) -> cast(sign(x.start - y.start) as int))").alias("more"))
    added = kept.select("doc_id", "sure", F.expr("""if(size(more) = 0, sure, concat(sure, aggregate(filter(more, x -> not exists(sure, y -> x.start < y.stop and y.start < x.stop)),
      struct(-1L as last, slice(more, 1, 0) as taken), (a, x) -> if(x.start < a.last, a, struct(x.stop as last, array_append(a.taken, x) as taken)), a -> a.taken)))""").alias("all"))
    ranked = added.select("doc_id", F.expr(f"array_sort(transform(all, x -> struct(array_position(array({order}), x.kind) as k, x.start as start, x.stop as stop, x.kind as kind, x.base as base, x.p as p)))").alias("all"))
    some = ranked.select("doc_id", F.expr("transform(all, x -> struct(x.kind as kind, x.start as start, x.stop as stop, x.base as base, x.p as p))").alias("spans"))
    return some.unionByName(table.where("spans is null").select("doc_id", F.expr("cast(array() as array<struct<kind: string, start: bigint, stop: bigint, base: boolean, p: double>>)").alias("spans")))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
