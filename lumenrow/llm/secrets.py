"""Secret scans: fixed patterns, and character Markov models for random strings of any form.

Base spans are the leftmost non-overlapping matches of three patterns. Beside
them, runs of key-like characters are scored by two first-order Markov models
over characters, one of random strings and one of ordinary identifiers, both
trained from labelled samples; a run whose log-likelihood ratio per pair of
characters exceeds a threshold is a span of kind ``markov``. The models judge
every run by itself, whether or not it lies in a base span: what the patterns
know serves as an independent test of the models, and what they don't is added.

Everything runs as DataFrame and SQL functions, in time proportional to the
text. The trained table has one ratio for each pair of characters, so it is
bounded by the alphabet alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of base spans, in order. Where a length is asked
# of a maximal run it is written into the pattern; an assignment is matched
# first and dropped if its value is short.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12
KINDS = ("assign", "access", "hex", "markov")

#: Characters of the models; anything else ends a candidate.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: A candidate is a whole run of these, of 16 or more, with a digit or a change of case.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*?(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9+/_-]{16,}+={0,2}"
#: Mean log-likelihood ratio of a character pair above which a run is taken as random.
THRESHOLD = 0.4
SMOOTHING = 0.5
REDACTED = "[SECRET]"
#: Code points of the segments that a text is cut into before parts of it are taken out.
SEGMENT = 4096

# Parts of ordinary identifiers.
PARTS = (
    "account active address amount application array article attribute author average background balance buffer builder cache "
    "callback category channel character client collection column command comment config connection content context control "
    "counter create current customer database default delete description destination device directory document download "
    "element encoder entity entry error event example expected factory field filename filter folder format function "
    "generator global handler header height history identifier image index information input instance interface internal "
    "invoice iterator language length library license listener local location manager mapping maximum message method minimum "
    "module monitor network notification number object offset operation option order output package parameter parent password "
    "payment permission picture position previous process product profile project property protocol provider query random "
    "range record reference region register request resource response result return schedule schema search section select "
    "sender sequence server service session setting shipping signal source standard statement status storage stream string "
    "structure subject system table target template temporary thread timeout timestamp total transaction transfer translation "
    "update upload user validate value variable vector version virtual visible warning width window worker wrapper"
)


def labelled_samples(spark: SparkSession, n: int = 2000) -> DataFrame:
    """``sample`` and ``is_random``: by rule, n digests in four alphabets and n identifiers in four styles."""
    words = F.split(F.lit(PARTS), " ")
    size = len(PARTS.split(" "))
    ids = spark.range(n)
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(size)) + 1).cast("int"))
    digest = F.sha2(F.col("id").cast("string"), 512)
    plain = F.base64(F.unhex(digest))
    random = F.element_at(F.array(F.substring(digest, 1, 40), F.substring(F.regexp_replace(plain, "[\n\r=]", ""), 1, 40), F.translate(F.substring(F.regexp_replace(plain, "[\n\r=]", ""), 1, 40), "+/", "-_"), F.upper(F.conv(F.substring(digest, 1, 15), 16, 36))), (F.pmod("id", F.lit(4)) + 1).cast("int"))
    a, b, c = pick(1), pick(2), pick(3)
    number = F.pmod("id", F.lit(100)).cast("string")
    ordinary = F.element_at(F.array(F.concat_ws("_", a, b, c), F.concat(a, F.initcap(b), F.initcap(c), number), F.concat_ws("-", a, b, number), F.upper(F.concat_ws("_", a, b))), (F.pmod("id", F.lit(4)) + 1).cast("int"))
    return ids.select(F.explode(F.array(F.struct(random.alias("sample"), F.lit(True).alias("is_random")), F.struct(ordinary.alias("sample"), F.lit(False).alias("is_random")))).alias("s")).select("s.*")


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratios, random over ordinary, of each pair of characters, row by row over ALPHABET.

    Pairs are counted by the cluster; at most two counts for each pair of
    characters reach the driver. Null samples and characters outside the
    alphabet add nothing; without samples all ratios are zero.
    """
    n = len(ALPHABET)
    at = "CAST(locate(substr(sample, {0}, 1), alphabet) AS INT)"
    pairs = samples.where("length(sample) > 1").select("sample", "is_random", F.lit(ALPHABET).alias("alphabet")).select("is_random", F.explode(F.expr(f"transform(sequence(1, length(sample) - 1), i -> struct({at.format('i')} AS a, {at.format('i + 1')} AS b))")).alias("p"))
    counts = pairs.where("p.a > 0 AND p.b > 0").groupBy("is_random", "p.a", "p.b").count().collect()
    seen = {True: {}, False: {}}
    total = {True: [0] * n, False: [0] * n}
    for r in counts:
        seen[r["is_random"]][r["a"] - 1, r["b"] - 1] = r["count"]
        total[r["is_random"]][r["a"] - 1] += r["count"]
    p = lambda kind, a, b: (seen[kind].get((a, b), 0) + SMOOTHING) / (total[kind][a] + SMOOTHING * n)
    return [math.log(p(True, a, b) / p(False, a, b)) for a in range(n) for b in range(n)]


def _sql(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


_NONE = "CAST(array() AS ARRAY<STRUCT<start: INT, rank: INT, end: INT>>)"


def _running(values: str, merge: str) -> str:
    """SQL: the running sum or maximum (``merge`` of x and y, with 0 as its neutral element) of an int array, by doubling.

    An accumulator that grows by one item a step is copied each time; here are
    as many steps as the array's length has bits.
    """
    shifted = "concat(array_repeat(0, least(shiftleft(1, k), size(acc))), slice(acc, 1, greatest(size(acc) - shiftleft(1, k), 0)))"
    return f"aggregate(sequence(0, CAST(ceil(log2(greatest(size({values}), 1))) AS INT)), {values}, (acc, k) -> zip_with(acc, {shifted}, (x, y) -> {merge}))"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _places(pattern: str, kind: str) -> str:
    """SQL: (start, rank, end) in code points of the matches ``found`` in ``lr_text``.

    The text is split at the matches, so lengths of what lies between and of
    the matches themselves add up to the places.
    """
    steps = f"zip_with(slice(split(lr_text, {_sql(pattern)}, -1), 1, size(found)), found, (gap, w) -> length(gap) + length(w))"
    return _let("steps", steps, f"zip_with({_running('steps', 'x + y')}, found, (last, w) -> struct(last - length(w) AS start, {KINDS.index(kind)} AS rank, last AS end))")


def _spans(pattern: str, kind: str, group: int = 0, least: int = 0) -> str:
    """SQL: the matches in ``lr_text`` whose ``group`` has ``least`` characters, as an array of (start, rank, end)."""
    p = _sql(pattern)
    places = _places(pattern, kind)
    if least:
        places = f"transform(filter(zip_with({places}, regexp_extract_all(lr_text, {p}, {group}), (s, v) -> struct(s AS s, length(v) AS n)), x -> x.n >= {least}), x -> x.s)"
    return f"CASE WHEN lr_text RLIKE {p} THEN {_let('found', f'regexp_extract_all(lr_text, {p}, 0)', places)} ELSE {_NONE} END"


def _ratio(run: str) -> str:
    """SQL: the mean log-likelihood ratio of a run's pairs of characters; a run is cut into characters once."""
    n = len(ALPHABET)
    codes = f"transform(split(rtrim('=', {run}), ''), c -> locate(c, '{ALPHABET}'))"
    pairs = f"zip_with(slice(codes, 1, size(codes) - 1), slice(codes, 2, size(codes) - 1), (a, b) -> element_at(lr_ratios, (a - 1) * {n} + b))"
    return _let("codes", codes, f"aggregate({pairs}, 0D, (acc, x) -> acc + x) / (size(codes) - 1)")


def _random_spans(threshold: float) -> str:
    """SQL: the candidates in ``lr_text`` that the models find random."""
    p = _sql(CANDIDATE)
    judged = f"filter(zip_with({_places(CANDIDATE, 'markov')}, found, (s, w) -> struct(s AS s, {_ratio('w')} AS ratio)), x -> x.ratio > {threshold})"
    return f"CASE WHEN lr_text RLIKE {p} THEN {_let('found', f'regexp_extract_all(lr_text, {p}, 0)', f'transform({judged}, x -> x.s)')} ELSE {_NONE} END"


def scan(df: DataFrame, ratios: list[float], threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """df with ``lr_base`` and ``lr_spans``: arrays of (start, rank, end) sorted by start and then kind.

    A null text counts as empty and has no span. Columns of df keep their names.
    """
    made = df.withColumn("lr_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("lr_ratios", F.lit(ratios))
    made = made.withColumn("lr_base", F.sort_array(F.concat(F.expr(_spans(ASSIGN, "assign", 2, ASSIGN_VALUE)), F.expr(_spans(ACCESS, "access")), F.expr(_spans(HEX, "hex")))))
    return made.withColumn("lr_spans", F.sort_array(F.concat("lr_base", F.expr(_random_spans(threshold))))).drop("lr_ratios", "lr_text")


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at({names}, s.rank + 1), ':', s.start, ':', s.end)), ',')")


def secret_spans(df: DataFrame, samples: DataFrame | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_markov.

    Spans are kind:start:end in code points, end exclusive, by start and then
    kind; a random run within a base span is a span of its own. Null and empty
    texts have none. Repeated rows and null doc_ids stay;
    an empty table gives an empty result; other columns aren't read.
    """
    ratios = train(labelled_samples(df.sparkSession) if samples is None else samples)
    found = scan(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ratios, threshold)
    count = lambda spans, kind: F.expr(f"CAST(size(filter({spans}, s -> s.rank = {KINDS.index(kind)})) AS BIGINT)")
    return found.select("doc_id", *(count("lr_base", k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_joined("lr_base"), 256).alias("base_sha256"), _joined("lr_spans").alias("spans"), count("lr_spans", "markov").alias("n_markov"))


def redact(df: DataFrame, samples: DataFrame | None = None, threshold: float = THRESHOLD, text_col: str = "text", mark: str = REDACTED, length_col: str | None = None) -> DataFrame:
    """df with each secret in ``text_col`` replaced by ``mark``; overlapping spans become one. A null text stays null.

    ``length_col``, if given, gets the new number of characters in rows that change.
    """
    ratios = train(labelled_samples(df.sparkSession) if samples is None else samples)
    # in a struct, so that no column's name can clash
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("lr_row"), F.col(f"`{text_col}`").alias("lr_in"))
    found, text = scan(rows, ratios, threshold, "lr_in"), "lr_in"
    # what is kept, as (a, b): what lies before each span that begins past all earlier ones, and the rest
    before = "concat(array(0), slice(ends, 1, size(ends) - 1))"
    gaps = f"filter(zip_with({before}, lr_spans, (a, s) -> struct(a AS a, s.start AS b)), g -> g.a <= g.b)"
    kept = _let("ends", _running("transform(lr_spans, s -> s.end)", "greatest(x, y)"), f"concat({gaps}, array(struct(element_at(ends, -1) AS a, length({text}) AS b)))")
    seg = lambda k: f"coalesce(get(segs, g.{k} div {SEGMENT}), '')"
    part = f"""IF(g.a div {SEGMENT} = g.b div {SEGMENT}, substr({seg("a")}, g.a % {SEGMENT} + 1, g.b - g.a),
        concat(substr({seg("a")}, g.a % {SEGMENT} + 1), array_join(slice(segs, CAST(g.a div {SEGMENT} AS INT) + 2, CAST(g.b div {SEGMENT} - g.a div {SEGMENT} AS INT) - 1), ''), substr({seg("b")}, 1, g.b % {SEGMENT})))"""
    hidden = _let("segs", f"regexp_extract_all({text}, r'(?s).{{1,{SEGMENT}}}', 0)", f"array_join(transform({kept}, g -> {part}), '{mark}')")
    changed = found.withColumn("lr_out", F.when(F.size("lr_spans") > 0, F.expr(hidden)).otherwise(F.col("lr_in")))
    own = lambda c: F.col("lr_row").getField(c)
    made = {text_col: F.col("lr_out")}
    if length_col is not None:
        made[length_col] = F.when(F.size("lr_spans") > 0, F.char_length("lr_out").cast(df.schema[length_col].dataType)).otherwise(own(length_col))
    return changed.select(*(made.get(c, own(c)).alias(c) for c in df.columns))
