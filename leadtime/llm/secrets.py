"""Secret scans: candidates by pattern, a random forest against false positives, all in Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialize

#: Characters of context on each side of a candidate.
NEAR = 48
#: Candidates: what is assigned, from 8 on, whole, after [=:], as many spaces as the context shows and a quote; or words of 16 or more
#: letters, digits and underscores that hold a digit or are upper case.
CANDIDATE = (
    r"(?<![A-Za-z0-9_])(?:(?=[A-Za-z0-9_+/\-]{8})(?<=[=:][ \t]{0,%d}[\"']?)[A-Za-z0-9_+/\-]{8,}+|(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{16,}+|[A-Z0-9]{16,}+(?![A-Za-z0-9_]))" % NEAR
)
MASK = "[SECRET]"
#: Words before a value that name a secret.
KEYWORDS = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer)"
#: Changes between lower and upper case.
CASES = r"(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"
FEATURES = ("length", "digits", "upper", "switches", "common_pairs", "dictionary", "path", "keyword", "assigned", "word_before", "word_after", "distinct", "case_switches")


def _share(count: str, of: str) -> str:
    return f"cast({count} as double) / greatest(cast({of} as double), 1d)"


@dataclass(frozen=True)
class Language:
    """What ordinary text is made of: frequent words and frequent pairs of letters."""

    words: tuple[str, ...]
    pairs: tuple[str, ...]


@dataclass(frozen=True)
class Forest:
    """Trees as SQL over an array x of features; the score is the share of trees that vote for a secret."""

    trees: tuple[str, ...]
    language: Language


def learn_language(documents: DataFrame, n_words: int = 400, n_pairs: int = 150) -> Language:
    """The most frequent words of 3 to 12 letters of all texts, and the most frequent pairs of letters in them, each word counting as often as it occurs.

    Counts are combined on the map side and written once; only the n most frequent of each pass the driver.
    """
    words = documents.select(F.explode(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"(?<![\p{L}\p{N}_])\p{L}{3,12}(?![\p{L}\p{N}_])"), 0)).alias("w")).groupBy("w").count()
    words = materialize(words, "words")
    top = [r["w"] for r in words.orderBy(F.col("count").desc(), "w").limit(n_words).collect()]
    pairs = words.select(F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substr(w, i, 2))")).alias("p"), "count").groupBy("p").agg(F.sum("count").alias("n"))
    common = [r["p"] for r in pairs.orderBy(F.col("n").desc(), "p").limit(n_pairs).collect()]
    drop(words)
    return Language(tuple(top), tuple(common))


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) or "''"


def _features(language: Language) -> str:
    """SQL array of FEATURES over c.value, c.before, c.after; regexes are raw strings. Each takes time in proportion to the value's length."""
    v, low = "c.value", "lower(c.value)"
    words = "|".join(sorted(language.words, key=lambda w: (-len(w), w))) or "(?!)"
    after: dict[str, str] = {}
    for pair in language.pairs:
        after[pair[0]] = after.get(pair[0], "") + pair[1]
    pairs = "(?=" + "|".join(f"{a}[{b}]" for a, b in sorted(after.items())) + ")" if after else "(?!)"
    parts = [
        f"cast(length({v}) as double)",
        _share(f"regexp_count({v}, r'[0-9]')", f"length({v})"),
        _share(f"regexp_count({v}, r'[A-Z]')", f"length({v})"),
        _share(f"regexp_count({v}, r'(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]')", f"length({v}) - 1"),
        _share(f"regexp_count({low}, r'{pairs}')", f"length({v}) - 1"),
        _share(f"length({v}) - length(regexp_replace({low}, r'{words}', ''))", f"length({v})"),
        "cast(c.before rlike r'[/\\\\@.]$' or c.after rlike r'^(?:[/\\\\@]|\\.[A-Za-z])' as int) * 1d",
        f"cast(c.before rlike r'{KEYWORDS}[^A-Za-z0-9]*$' as int) * 1d",
        "cast(c.before rlike r'[=:][ \\t\\x22\\x27]*$' as int) * 1d",
        f"cast(array_contains(array({_quoted(language.words)}), lower(regexp_extract(c.before, r'(\\p{{L}}+)[^\\p{{L}}]*$', 1))) as int) * 1d",
        f"cast(array_contains(array({_quoted(language.words)}), lower(regexp_extract(c.after, r'^[^\\p{{L}}]*(\\p{{L}}+)', 1))) as int) * 1d",
        _share(f"size(array_distinct(split({v}, '')))", f"length({v})"),
        _share(f"regexp_count({v}, r'{CASES}')", f"length({v}) - 1"),
    ]
    return "array(" + ", ".join(parts) + ")"


def _cut(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` plus __row, __values (the candidates) and __pieces (the texts between them).

    What follows must use the arrays more than once, or filter with the row number in use: else the optimizer moves the two regular
    expressions into later filters and lambdas, where they run anew for every candidate.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return rows.withColumns({"__row": F.monotonically_increasing_id(), "__values": F.regexp_extract_all(t, F.lit(CANDIDATE), 0), "__pieces": F.split(t, CANDIDATE, -1)})


#: The i-th candidate of a row: what stands before it reaches into the candidate before, which may be the name of what is assigned.
_FOUND = f"transform(__values, (v, i) -> named_struct('gap', length(__pieces[i]), 'value', v, 'before', right(concat(if(i > 0, right(__values[i - 1], {NEAR}), ''), __pieces[i]), {NEAR}), 'after', left(__pieces[i + 1], {NEAR})))"


def candidates(documents: DataFrame) -> DataFrame:
    """One narrow row a candidate: doc_id, start (code points from 0), value, before, after.

    Written once, so that texts are read and cut once whatever is asked of the candidates. Starts are running sums of lengths within a
    text. Null and empty texts have no candidates; repeated rows have theirs each; all time is in proportion to the length of the
    texts, however many or long their candidates are.
    """
    rows = _cut(documents.select("doc_id", "text")).filter("size(__values) > 0")
    rows = rows.select("doc_id", "__row", F.posexplode(F.expr(_FOUND)).alias("at", "c"))
    rows = materialize(rows.select("doc_id", "__row", "at", "c.gap", "c.value", "c.before", "c.after"), "candidates")
    ends = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("__row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("doc_id", (ends - F.length("value")).cast("long").alias("start"), "value", "before", "after")


def _score(forest: Forest) -> str:
    """SQL of the share of trees that vote for a secret, over an array x of features."""
    votes = " + ".join(f"({t})" for t in forest.trees) or "0d"
    return f"({votes}) / {max(1, len(forest.trees))}d"


def rule_label(value: Column, before: Column, after: Column) -> Column:
    """Labels of findings that need no model: 1 for known forms and named assignments of mixed values, 0 for numbers, words and parts of paths or addresses, null where unsure. Mixed are letters with digits, or without if the case changes at two of five letters."""
    cased = F.regexp_count(value, F.lit(CASES)) * 5 >= (F.length(value) - 1) * 2
    mixed = value.rlike(r"[A-Za-z]") & (value.rlike(r"[0-9]") | cased)
    return (
        F.when(value.rlike(r"^AKIA[A-Z0-9]{16}$"), 1)
        .when(before.rlike(KEYWORDS + r"[\"']?\s*[=:]\s*[\"']?$") & mixed & (F.length(value) >= 12), 1)
        .when(value.rlike(r"^[0-9_]+$") | ~value.rlike(r"[0-9]") & ~cased, 0)
        .when(before.rlike(r"[/\\@.]$") | after.rlike(r"^[/\\@]"), 0)
    )


def _compiled(debug: str) -> str:
    """A tree printed by Spark, as nested SQL conditions over x."""
    lines = [x.strip() for x in debug.splitlines() if x.strip().startswith(("If", "Else", "Predict"))]

    def node(at: int) -> tuple[str, int]:
        if lines[at].startswith("Predict"):
            return f"{float(lines[at].split(':')[1])!r}d", at + 1
        feature, limit = lines[at][lines[at].index("feature") + 8 : -1].split(" <= ")
        yes, at = node(at + 1)
        no, at = node(at + 1)
        return f"if(x[{int(feature)}] <= {float(limit)!r}d, {yes}, {no})", at

    return node(0)[0]


def train(findings: DataFrame, language: Language, trees: int = 24, depth: int = 5, per_label: int = 4000, seed: int = 11) -> Forest:
    """Random forest from labelled findings (value, before, after, label in {0,1}).

    Learns from at most ``per_label`` findings of each label, those with the smallest hash. Null labels do not count. With
    findings of one label only, the forest is that label; without any, nothing is held for a secret.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    known = findings.filter(F.col("label").isin(0, 1)).select("value", "before", "after", F.col("label").cast("double").alias("label")).distinct()
    order = [F.xxhash64("value", "before", "after"), F.col("value"), F.col("before"), F.col("after")]
    chosen = known.filter("label = 0").orderBy(*order).limit(per_label).unionByName(known.filter("label = 1").orderBy(*order).limit(per_label))
    data = chosen.select(F.struct("value", "before", "after").alias("c"), "label").select(F.expr(_features(language)).alias("x"), "label")
    data = materialize(data, "findings")  # at most 2 * per_label rows
    classes = sorted(r[0] for r in data.select("label").distinct().collect())
    if len(classes) < 2:
        return Forest(tuple(f"{c!r}d" for c in classes), language)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", subsamplingRate=0.8)
    fitted = model.fit(data.coalesce(1).select(array_to_vector("x").alias("features"), "label"))
    return Forest(tuple(_compiled(t.toDebugString) for t in fitted.trees), language)


def labelled_by_rules(found: DataFrame) -> DataFrame:
    """``candidates`` with the label that ``rule_label`` gives, null where it is unsure."""
    return found.select("value", "before", "after", rule_label(F.col("value"), F.col("before"), F.col("after")).alias("label"))


def learn(documents: DataFrame, labelled: DataFrame | None = None, found: DataFrame | None = None, **settings) -> Forest:
    """Forest from ``labelled`` findings (value, before, after, label), or else from the findings of ``documents`` that ``rule_label`` is sure of.

    ``found``: ``candidates`` of the documents, if they are there already.
    """
    language = learn_language(documents)
    if labelled is None:
        labelled = labelled_by_rules(candidates(documents) if found is None else found)
    return train(labelled, language, **settings)


def scan(documents: DataFrame, forest: Forest, cut: float = 0.5, found: DataFrame | None = None) -> DataFrame:
    """One row per finding: doc_id, start, length, value_sha256, score, is_secret.

    Documents without candidates, null and empty texts give no rows; repeated rows give repeated findings, and equal scores are all above or all
    below the cut (a score equal to it is a secret). Null doc_ids stay null; other columns of the documents are not read. No Python.
    """
    rows = (candidates(documents) if found is None else found).withColumn("c", F.struct("value", "before", "after"))
    rows = rows.withColumn("x", F.expr(_features(forest.language))).withColumn("score", F.expr(_score(forest)))
    return rows.select(
        "doc_id", "start", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"),
        F.round("score", 6).alias("score"), (F.col("score") >= cut).alias("is_secret"),
    )


def redacted(documents: DataFrame, forest: Forest, cut: float = 0.5) -> DataFrame:
    """``documents`` with every secret found replaced by MASK, and n_chars counted anew where that changed the text.

    All rows and columns stay, in their order; texts without secrets, nulls included, are untouched. A map stage without shuffle: the
    candidates of a text are scored within its row. Names __row, __values, __pieces and __secret are reserved.
    """
    own = documents.columns
    one = f"transform(array({_features(forest.language)}), x -> {_score(forest)} >= {cut}d)[0]"
    rows = _cut(documents).withColumn("__secret", F.expr(f"transform({_FOUND}, c -> {one})"))
    hit = F.expr("exists(__secret, s -> s)")
    text = F.concat_ws("", F.expr(f"transform(__pieces, (p, i) -> concat(p, if(i < size(__values), if(__secret[i], '{MASK}', __values[i]), '')))"))
    rows = rows.withColumn("__hit", hit).withColumn("text", F.when(F.col("__hit"), text).otherwise(F.col("text")))
    if "n_chars" in own:
        kind = documents.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.col("__hit"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in own])
