"""Personal data in free text: found by weak supervision, replaced by typed placeholders.

1. Every text is scanned once for candidate spans, each with the votes of the labelers of its form and of its
   surroundings (pii_spans.py); the words written in lower case are counted with them.  Both are written to the shared
   folder; the candidates are some per mille of the text.
2. Gazetteers are gathered from the corpus itself: words that stand where the other labelers are sure, words of
   candidates that are common words elsewhere, words with many or few partners.  They are tables, joined on the word,
   and vote as labelers too.
3. Expectation maximisation over the counts of vote patterns (at most 3 ** 11 a kind) estimates each labeler's
   reliability and the probability of each pattern (Dawid and Skene 1979).
4. A logistic span classifier is fitted to these probabilities, over the patterns of all candidates, and scores each
   candidate as a column expression.  Of spans that overlap the best is kept.

Traps (robots' mailboxes, remotes, words of an address) are a labeler like the others, but with a reliability that is
known; the classifier learns its weight with those of the others and decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmill.llm.pii_spans import KINDS, LABELERS, candidates
from starmill.session import written

#: Gazetteers of surely true words: the first key, the last key, the end of the last key.
SLOTS = ("first", "last", "ending")
#: Labelers by the corpus: those gazetteers, whether a name's words are common words, how many partners its words have.
VOTERS = (*LABELERS, *SLOTS, "common", "partners")
TRAP = VOTERS.index("trap")
#: Log odds of what the labeler of traps votes against, and the weight of what is believed before anything is counted.
TRAP_ODDS, BELIEF = -8.0, 0.1
#: Kind of the rows that count words in lower case, and how many different ones a task gathers before it hands them on.
WORD, WORDS_HELD = "word", 200_000


def scan(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, kind, a, b, found, first, last, votes array<int>) of all candidates; offsets count characters.

    Rows of kind WORD have in ``found`` a word in lower case and in ``a`` how often it is in some of the texts.
    """
    schema = T.StructType([T.StructField("doc", df.schema[key].dataType), T.StructField("kind", T.StringType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("found", T.StringType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("votes", T.ArrayType(T.IntegerType()))])
    doc_type = pa.string() if isinstance(df.schema[key].dataType, T.StringType) else pa.int64()
    types = [doc_type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, types, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        counted = lambda: batch_of([(None, WORD, n, 0, w, "", "", None) for w, n in words.items()])
        for batch in batches:
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                rows += [(doc, kind, a, b, t[a:b], first, last, [v[x] for x in LABELERS]) for kind, a, b, first, last, v in candidates(t)]
                words.update(w for w in (t or "").split() if w.isalpha() and w.islower())
            yield batch_of(rows)
            if len(words) >= WORDS_HELD:
                yield counted()
                words.clear()
        yield counted()

    return df.select(key, text).mapInArrow(run, schema)


def with_gazetteers(scanned: DataFrame) -> DataFrame:
    """The candidates of ``scan`` with the votes of the gazetteers appended to ``votes``."""
    v = lambda name: F.get("votes", F.lit(LABELERS.index(name)))
    total = F.aggregate("votes", F.lit(0), lambda acc, x: acc + x)
    sure = (v("form") > 0) & (v("trap") >= 0) & F.when(F.col("kind") == "name", (v("before") > 0) & (v("after") > 0) & ((v("line") > 0) | (v("prose") > 0))).otherwise(total >= 2)
    keyed = scanned.where(F.col("kind") != WORD).withColumns({"sure": sure, "ending": F.when(F.col("kind") == "name", F.expr("right(last, 4)"))})
    for slot in SLOTS:
        known = keyed.groupBy("kind", slot).agg(F.sum(F.col("sure").cast("int")).alias("n_sure"), F.count(F.lit(1)).alias("n_all"))
        vote = F.when((F.col("n_sure") >= 2) & (F.col("n_sure") >= 0.2 * F.col("n_all")), 1).when((F.col("n_all") >= 3) & (F.col("n_sure") <= 0.02 * F.col("n_all")), -1).otherwise(0)
        known = known.where(F.col(slot) != "").select(F.col("kind").alias("k"), F.col(slot).alias("w"), vote.alias(f"vote_{slot}"))
        keyed = keyed.join(known, (F.col("kind") == F.col("k")) & (F.col(slot) == F.col("w")), "left").drop("k", "w")
    lower = scanned.where(F.col("kind") == WORD).groupBy(F.col("found").alias("w")).agg(F.sum("a").alias("n_lower"))
    pairs = keyed.where("kind = 'name'").groupBy("first", "last").agg(F.count(F.lit(1)).alias("n"))
    for slot in ("first", "last"):
        stats = pairs.groupBy(F.col(slot).alias("w")).agg(F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("n_pairs")).join(lower, "w", "left")
        common = F.when(F.col("n_lower") >= F.col("n_all"), -1).otherwise(0)
        # a name's words come with many others; those of a title or heading come back together
        partners = F.when((F.col("n_all") >= 20) & (F.col("n_pairs") <= 0.05 * F.col("n_all")), -1).when((F.col("n_all") >= 5) & (F.col("n_pairs") >= 0.5 * F.col("n_all")), 1).otherwise(0)
        stats = stats.select(F.lit("name").alias("k"), "w", common.alias(f"common_{slot}"), partners.alias(f"partners_{slot}"))
        keyed = keyed.join(stats, (F.col("kind") == F.col("k")) & (F.col(slot) == F.col("w")), "left").drop("k", "w")
    held = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = F.when(F.least(held("partners_first"), held("partners_last")) < 0, -1).otherwise(F.greatest(held("partners_first"), held("partners_last")))
    votes = F.concat("votes", F.array(*[held(f"vote_{slot}") for slot in SLOTS], F.least(held("common_first"), held("common_last")), both))
    return keyed.withColumn("votes", votes).select(*scanned.columns)


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Probability of each vote pattern (rows of -1, 0, 1) to be true, by expectation maximisation.

    Labelers are taken as independent given the truth; a labeler of the text that sees no sign tells something by
    that, a gazetteer that does not know a word tells nothing.  It starts from the majority, and smoothing keeps a
    labeler from ever being certain.  What is believed beforehand, that votes for come with true candidates and votes
    against with false ones, counts BELIEF of the candidates: without it nothing would tell classes apart whose votes
    agree.  The reliability of the labeler of traps is known (TRAP_ODDS), not estimated, and what it votes against takes
    no part in the estimation: a corpus full of robots' mail would spoil the others' figures.
    """
    free = np.array(patterns)
    trapped = free[:, TRAP] < 0
    free[:, TRAP] = 0
    n = np.where(trapped, 0.0, counts)
    p = 1 / (1 + np.exp(-1.5 * (free.sum(axis=1) - 0.5)))
    hot = np.stack([free == x for x in (-1, 0, 1)], axis=2).astype(float)
    hot[:, len(LABELERS) :, 1] = 0.0
    true = np.tile([0.1, 0.45, 0.45], (free.shape[1], 1)) * n.sum() * BELIEF
    for _ in range(rounds):
        logs = []
        for w, before in ((p * n, true), ((1 - p) * n, true[:, ::-1])):
            votes = np.einsum("p,pvx->vx", w, hot) + before
            share = (votes + 1.0) / (votes.sum(axis=1, keepdims=True) + 3.0)
            logs.append(np.einsum("pvx,vx->p", hot, np.log(share)) + np.log((w.sum() + 1) / (n.sum() + 2)))
        odds = np.clip(logs[0] - logs[1], -6, 6)  # labelers are not quite independent: no pattern is certain
        p = 1 / (1 + np.exp(-odds))
    return 1 / (1 + np.exp(-(odds + TRAP_ODDS * trapped)))


#: Features of a span besides its votes: expressions over ``found``, each about 0 to 1.
SPAN_FEATURES = ("least(length(found), 60) / 60.0", "length(regexp_replace(found, '[^0-9]', '')) / greatest(length(found), 1)", "length(regexp_replace(found, '[^\\\\p{Lu}]', '')) / greatest(length(found), 1)", "least(size(split(found, ' ')), 8) / 8.0")


def features(votes: np.ndarray, spans: np.ndarray | None = None) -> np.ndarray:
    extra = np.zeros((len(votes), len(SPAN_FEATURES))) if spans is None else spans
    return np.column_stack([np.ones(len(votes)), votes > 0, votes < 0, extra]).astype(float)


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels, by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def train(voted: DataFrame) -> dict[str, np.ndarray]:
    """Weights of the span classifier of each kind.

    It is fitted on the vote patterns of all candidates with the means of their span features, weighted by the root of
    their numbers, so that a rare pattern teaches something too.  Labels are the patterns' probabilities.
    """
    # at most 3 ** len(VOTERS) patterns a kind, whatever the corpus
    means = [F.avg(F.expr(e).cast("double")).alias(f"f{k}") for k, e in enumerate(SPAN_FEATURES)]
    counted = voted.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n"), *means).toPandas()
    models = {}
    for kind in KINDS:
        own = counted[counted.kind == kind]
        if not len(own):
            continue
        patterns, counts = np.array(own.votes.tolist()).reshape(len(own), len(VOTERS)), own.n.to_numpy(float)
        spans = own[[f"f{k}" for k in range(len(SPAN_FEATURES))]].to_numpy(float)
        models[kind] = fit_logistic(features(patterns, spans), reliabilities(patterns, counts), np.sqrt(counts), ridge=0.05)
    return models


def score(models: dict[str, np.ndarray]) -> Column:
    """Probability of a candidate as a column expression; null for kinds without a model."""
    out = F.lit(None).cast("double")
    for kind, beta in models.items():
        n = len(VOTERS)
        z = F.lit(float(beta[0]))
        for k in range(n):
            v = F.get("votes", F.lit(k))
            z = z + F.when(v > 0, float(beta[1 + k])).when(v < 0, float(beta[1 + n + k])).otherwise(0.0)
        for k, e in enumerate(SPAN_FEATURES):
            z = z + F.expr(e).cast("double") * float(beta[1 + 2 * n + k])
        out = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-z))).otherwise(out)
    return out


def best_spans(scored: DataFrame) -> DataFrame:
    """Of the spans of a document that overlap, the likeliest (then the longest, then the first) is kept."""
    by_start = W.partitionBy("doc").orderBy("a", "b", "kind")
    reach = F.max("b").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    cluster = F.sum(F.when(F.col("a") >= F.coalesce("reach", F.lit(0)), 1).otherwise(0)).over(by_start.rowsBetween(W.unboundedPreceding, 0))
    rank = F.struct((-F.round("p", 6)).alias("s"), (F.col("a") - F.col("b")).alias("l"), "a", "b", "kind", "found")
    grouped = scored.withColumn("reach", reach).withColumn("cluster", cluster).groupBy("doc", "cluster").agg(F.array_sort(F.collect_list(rank)).alias("spans"))
    none = F.filter("spans", lambda s: F.lit(False))
    kept = F.aggregate("spans", none, lambda acc, s: F.when(F.exists(acc, lambda o: (o["a"] < s["b"]) & (s["a"] < o["b"])), acc).otherwise(F.concat(acc, F.array(s))))
    return grouped.select("doc", F.explode(kept).alias("s")).select("doc", "s.kind", "s.a", "s.b", "s.found", (-F.col("s.s")).alias("p"))


def find_personal(df: DataFrame, key: str, text: str, threshold: float = 0.5) -> DataFrame:
    """(doc, kind, a, b, found, p): personal data of each text; a and b are character offsets.

    Null and empty texts hold none.  A corpus without candidates gives no rows.
    """
    voted = written(with_gazetteers(written(scan(df, key, text), "candidates")), "voted")  # read for the counts and the scores
    scored = voted.withColumn("p", score(train(voted))).where(F.col("p") > threshold)
    return best_spans(scored)


def redact(df: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """``df`` with ``text`` rewritten: each span is replaced by its kind in brackets, the rest stays as it is.

    One shuffle of the texts by key; rows without spans, null keys and null texts stay unchanged.
    """
    own = spans.groupBy(F.col("doc").alias("__doc")).agg(F.array_sort(F.collect_list(F.struct("a", "b", "kind"))).alias("__spans"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.struct(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["a"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["b"].alias("at"))
    done = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    return df.join(own, df[key] == F.col("__doc"), "left").withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(done)).drop("__doc", "__spans")
