"""Quality classifier: document evidence combined with host and path posteriors (hierarchical empirical Bayes).

Evidence.  A document shows indicator features: its words, the levels of a few style measures and, for
toxicity, how often (once, twice, three times) its words begin with the same 4 to 6 letters, as inflected and
compound forms are too rare to count whole.  On labelled documents Spark counts, per language and feature, how
often it comes with good and with toxic documents; features whose counts differ beyond chance (likelihood-ratio
test) get Bernoulli naive-Bayes weights, over all languages and, for toxicity, for each language by itself; a
document is judged by its own language's weights if that has any.  Each half of the labelled documents gives a
model, and a monotone map from score to probability, counted on the half that the weights have not seen, makes
its probabilities honest; the mean of the two models' probabilities counts.  A document is good with the
probability of quality times that of not being toxic.

Sites.  Expected good documents are summed per path and per host.  A host's mean is shrunk to the
global mean and a path's to its host's, with prior strengths estimated by the method of moments
from the spread of the means beyond sampling noise, so a site with few documents says little
and one with many speaks for itself.  Each document meets the posterior of its path with itself left
out, as prior odds for its own evidence.

Only the labelled sample for the classifier is bounded (``TRAIN_ROWS``, chosen by a hash of the
id); sums, spreads and posteriors cover all documents.  Texts are never shuffled.

Host and path come from ``source``: the host up to the first slash, the path what follows up to
the last slash, and the language as the site's section (sites split by language).

Defined results: null and empty texts show no words and are judged by style; a null source is
a host of its own; repeated labels of an id count once with the worst values, labels without an
id are dropped; without labels nothing is rejected; repeated rows are judged alike; columns
that clash with names used here are safe, as the input row travels in one struct.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import cut, join_checked, map_arrow, row_with_text, texts

#: Labelled documents that the classifier may use.
TRAIN_ROWS = 50_000
#: Features need this many documents and this much evidence (likelihood ratio) to count.
LEAST_DOCUMENTS = 5
LEAST_EVIDENCE = 25.0
#: Size of the model: the features with the most evidence.
MOST_FEATURES = 20_000
#: Documents with a lower posterior are rejected.
THRESHOLD = 0.5

_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_LEVELS = (0.0, 0.01, 0.03, 0.1, 0.3, 0.6)
TARGETS = ("quality", "toxic")
#: Lengths of the word beginnings, and the numbers of words with one that are features.
PREFIXES = (4, 5, 6)
TIMES = (1, 2, 3)
#: The part of all languages together, and what precedes a language's name.
WHOLE, LANGUAGE = "", "lang:"


def _level(share: float) -> int:
    return sum(share > x for x in _LEVELS)


def style(text: str) -> list[str]:
    """Levels of the style measures, as feature names that no word can be."""
    words = text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    top = 0
    if words:
        top = max(Counter(words).values())
    shares = {
        "symbols": sum(1 for w in words if _SYMBOLS.search(w)) / n if _SYMBOLS.search(text) else 0.0,
        "shout": sum(1 for w in words if len(w) > 1 and w.isupper()) / n,
        "bangs": sum(1 for w in words if w.endswith("!!")) / n,
        "again": sum(1 for a, b in zip(words, words[1:]) if a == b) / n,
        "top": top / n if n >= 20 else 0.0,
        "lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "digits": sum(1 for w in words if not w.isalpha() and any(c.isdigit() for c in w)) / n,
    }
    return [f"#{k}:{_level(v)}" for k, v in shares.items()] + [f"#length:{len(words).bit_length()}"]


def features(text: str, wanted: dict[str, set] | None = None) -> set[str]:
    """What a document shows: its lower-cased words, its style levels and its word beginnings (those ``wanted``, by the shortest)."""
    words = Counter(_WORD.findall(text.lower()))
    begins: dict[str, int] = {}
    for w, n in words.items():
        mine = None if wanted is None else wanted.get(w[:PREFIXES[0]], ())
        if mine != ():
            for k in PREFIXES:
                if len(w) >= k and (mine is None or w[:k] in mine):
                    begins[w[:k]] = begins.get(w[:k], 0) + n
    shown = set(words)
    if words and max(map(len, words)) > 64:
        shown = {w if len(w) <= 64 else "#long:" + hashlib.md5(w.encode()).hexdigest() for w in words}
    shown.update(style(text))
    shown.update(f"^{t}{w}" for w, n in begins.items() for t in TIMES if n >= t)
    return shown


#: Counters of a feature: documents with a label and with label 1, for both targets and both halves.
_COUNTERS = [f"{kind}_{t}_{half}" for half in (0, 1) for t in TARGETS for kind in ("n", "one")]


#: Features that a task holds counters of at a time; Spark sums what is counted in several goes.
HELD = 200_000
#: Counters that go to Spark at a time.
SENT = 20_000


def _count_batches(batches):
    """Counters per language and feature."""
    import pyarrow as pa

    places: dict[str, dict[str, int]] = {}  # language -> feature -> its line in the counters
    counters = np.zeros((HELD, len(_COUNTERS)), np.int32)
    used = 0

    def flush():
        for part, mine in places.items():
            names, lines = list(mine), np.fromiter(mine.values(), np.int64, len(mine))
            for lo in range(0, len(names), SENT):
                some = names[lo:lo + SENT]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(some), pa.string()), pa.array(some, pa.string()),
                     *(pa.array(c) for c in counters[lines[lo:lo + SENT]].astype(np.int64).T)], ["part", "feature", *_COUNTERS])
        places.clear()

    for batch in batches:
        for text, q, t, half, part in zip(batch.column(0), *(batch.column(i).to_pylist() for i in range(1, 5))):
            shown = ("#all", *features(text.as_py() or ""))
            if used + len(shown) > len(counters):
                yield from flush()
                counters, used = np.zeros((max(HELD, len(shown)), len(_COUNTERS)), np.int32), 0
            mine = places.setdefault(part, {})
            lines = []
            for f in shown:
                line = mine.get(f)
                if line is None:
                    line = mine[f] = used
                    used += 1
                lines.append(line)
            for i, x in enumerate((q is not None, q == 1, t is not None, t == 1)):
                if x:
                    counters[lines, 4 * half + i] += 1
    yield from flush()


def _evidence(ones: Column, n: Column, all_ones: Column, all_n: Column) -> Column:
    """Likelihood-ratio statistic of the two-by-two table of a feature and a label."""
    def cell(x, row, column):
        return F.when(x > 0, x * F.log(x * all_n / (row * column))).otherwise(0.0)

    rest, zeros = all_n - n, all_n - all_ones
    return 2 * (cell(ones, n, all_ones) + cell(n - ones, n, zeros)
                + cell(all_ones - ones, rest, all_ones) + cell(zeros - (n - ones), rest, zeros))


class Model:
    """Weights, biases and probability maps by target and part."""

    def __init__(self):
        self.weights: dict[tuple, dict[str, float]] = {}
        self.bias: dict[tuple, float] = {}
        self.map: dict[tuple, tuple] = {}

    def score(self, shown: set[str], key: tuple) -> float:
        weights = self.weights[key]
        return self.bias[key] + sum(weights[f] for f in shown & weights.keys())

    def probability(self, shown: set[str], target: str, lang: str | None) -> float | None:
        """By the document's own language if that has a map, else by all languages; null where nothing was learned."""
        for key in ((target, f"{LANGUAGE}{lang or ''}"), (target, WHOLE)):
            if key in self.map:
                edges, values = self.map[key]
                return values[min(max(_bin(self.score(shown, key)) - edges, 0), len(values) - 1)]
        return None


def beginnings(models: list[Model]) -> dict[str, set]:
    """The word beginnings with weights, by their first letters."""
    out: dict[str, set] = {}
    for f in {f for m in models for weights in m.weights.values() for f in weights if f[0] == "^"}:
        out.setdefault(f[2:2 + PREFIXES[0]], set()).add(f[2:])
    return out


def probability(models: list[Model], shown: set[str], target: str, lang: str | None) -> float | None:
    """The mean over the models that have learned something of the target."""
    known = [p for m in models if (p := m.probability(shown, target, lang)) is not None]
    return sum(known) / len(known) if known else None


def _bin(score: float) -> int:
    return math.floor(max(min(score, 60.0), -60.0) * 2)


def monotone(counts: list[tuple[int, int, int]]) -> tuple[int, list[float]]:
    """(first bin, probabilities by bin) from (bin, documents, ones): pooled so that they never fall."""
    counts = sorted(counts)
    blocks: list[list] = []  # ones, documents, bins
    low, high = counts[0][0], counts[-1][0]
    found = {b: (n, ones) for b, n, ones in counts}
    for b in range(low, high + 1):
        n, ones = found.get(b, (0, 0))
        blocks.append([ones, n, 1])
        while len(blocks) > 1 and (not blocks[-1][1] or not blocks[-2][1]
                                   or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            ones, n, bins = blocks.pop()
            blocks[-1] = [blocks[-1][0] + ones, blocks[-1][1] + n, blocks[-1][2] + bins]
    values = [(ones + 0.5) / (n + 1) for ones, n, bins in blocks for _ in range(bins)]
    return low, values


def _weigh(counts: DataFrame, whole: dict, half: int) -> Model:
    """Weights from the counters of a half; ``whole`` has the '#all' row of each part."""
    model = Model()
    for t in TARGETS:
        sums = {p: (r[f"n_{t}_{half}"], r[f"one_{t}_{half}"]) for p, r in whole.items()}
        sums = {p: (n, ones) for p, (n, ones) in sums.items() if 0 < ones < n and (t == "toxic" or p == WHOLE)}
        if not sums:
            continue
        every = F.broadcast(counts.sparkSession.createDataFrame(
            [(p, float(n), float(ones)) for p, (n, ones) in sums.items()], "part string, all_n double, all_ones double"))
        rows = counts.where("feature != '#all'" + ("" if t == "toxic" else " and not startswith(feature, '^')"))
        chosen = (rows.select("part", "feature", F.col(f"n_{t}_{half}").alias("n"), F.col(f"one_{t}_{half}").alias("ones")).where(F.col("n") >= LEAST_DOCUMENTS).join(every, "part")
                  .withColumn("evidence", _evidence(F.col("ones").cast("double"), F.col("n").cast("double"), F.col("all_ones"), F.col("all_n")))
                  .where(F.col("evidence") >= LEAST_EVIDENCE).orderBy(F.desc("evidence"), "feature", "part").limit(MOST_FEATURES).collect())
        for f in chosen:
            n, ones = sums[f.part]
            key = t, f.part
            p1, p0 = (f.ones + 0.5) / (ones + 1), (f.n - f.ones + 0.5) / (n - ones + 1)
            model.weights.setdefault(key, {})[f.feature] = math.log(p1 * (1 - p0) / (p0 * (1 - p1)))
            model.bias[key] = model.bias.get(key, math.log(ones / (n - ones))) + math.log((1 - p1) / (1 - p0))
    return model


def feature_counts(texts: DataFrame) -> DataFrame:
    """Counters per feature of each language and of all together (``WHOLE``), where they may reach the least, and the '#all' rows."""
    counts = map_arrow(texts, _count_batches, "part string, feature string, " + ", ".join(f"{c} bigint" for c in _COUNTERS))
    # a language's row is shuffled once; its copy for all languages is made where the feature's rows meet
    counts = counts.repartition("feature").select(F.explode(F.array("part", F.lit(WHOLE))).alias("part"), "feature", *_COUNTERS)
    return (counts.groupBy("part", "feature").agg(*(F.sum(c).alias(c) for c in _COUNTERS))
            .where(" or ".join(f"n_{t}_{h} >= {LEAST_DOCUMENTS}" for t in TARGETS for h in (0, 1)) + " or feature = '#all'"))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[Model]:
    """The models from at most ``rows`` labelled documents, none if nothing was learned."""
    sample = worst(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = cut(sample.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")), "quality-sample")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    texts = cut(texts.join(F.broadcast(sample), "doc_id").select(
        "text", "quality", "toxic", "half", F.concat(F.lit(LANGUAGE), "lang").alias("part")), "quality-texts")
    # few rows are left, which go to as few files
    counts = cut(feature_counts(texts).hint("rebalance"), "quality-counts")
    whole = {r.part: r for r in counts.where("feature = '#all'").collect()}  # one row for each language of the sample
    models = [_weigh(counts, whole, half) for half in (0, 1)] if whole else []
    wanted = [beginnings([m]) for m in models]

    def bins(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, q, label, half, part in zip(batch.column(0), *(batch.column(i).to_pylist() for i in range(1, 5))):
                other = 1 - half
                shown = features(text.as_py() or "", wanted[other])
                out += [(t, p, other, _bin(models[other].score(shown, (t, p))), 1, int(y == 1)) for t, y in zip(TARGETS, (q, label))
                        for p in (WHOLE, part) if y is not None and (t, p) in models[other].weights]
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(columns)],
                                             ["target", "part", "model", "bin", "n", "ones"])

    if any(m.weights for m in models):
        seen = (map_arrow(texts, bins, "target string, part string, model bigint, bin bigint, n bigint, ones bigint")
                .groupBy("target", "part", "model", "bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect())  # at most 242 bins each
        found: dict[tuple, list] = {}
        for r in seen:
            found.setdefault((r.model, r.target, r.part), []).append((r.bin, r.n, r.ones))
        for (m, t, p), mine in found.items():
            models[m].map[t, p] = monotone(mine)
    return [m for m in models if m.map]


def worst(labels: DataFrame) -> DataFrame:
    return (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"),
                          F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null")
            .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")))


def scored(docs: DataFrame, models: list[Model], keep: list[str]) -> DataFrame:
    """``row``, id, host, path and the probabilities of both targets (null where nothing was learned)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        wanted = beginnings(m)
        for batch in batches:
            q, t = [], []
            for text, lang in zip(texts(batch), batch.column("_lang").to_pylist()):
                shown = features(text.as_py() or "", wanted)
                q.append(probability(m, shown, "quality", lang))
                t.append(probability(m, shown, "toxic", lang))
            names = [n for n in batch.schema.names if n not in ("_text", "_lang")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(q, pa.float64()), pa.array(t, pa.float64())],
                                             [*names, "p_quality", "p_toxic"])

    source = F.regexp_replace(F.coalesce(F.col("source").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rows = docs.select(*row_with_text(docs, keep), F.col("doc_id").cast("bigint").alias("id"),
                       F.substring_index(source, "/", 1).alias("host"),
                       F.concat(F.regexp_extract(source, r"(?s)^[^/]*(/.*/|)", 1), F.lit("|"),
                                F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("path"),
                       F.col("lang").cast("string").alias("_lang"))
    schema = (f"row {rows.schema['row'].dataType.simpleString()}, id bigint, host string, path string, "
              "p_quality double, p_toxic double")
    return map_arrow(rows, run, schema)


def strength(spread: float, noise: float, weight: float, mean: float) -> float:
    """Prior strength by the method of moments: ``spread`` is the weighted sum of squared deviations of the
    group means, ``noise`` what sampling alone adds, ``weight`` the moment's divisor."""
    between = (spread - noise) / weight if weight > 0 else 0.0
    variance = mean * (1 - mean)
    if between <= 0 or variance <= 0:
        return 1e6
    return float(np.clip(variance / between - 1, 1.0, 1e6))


def site_posteriors(documents: DataFrame):
    """Per (host, path): sums, the prior strengths and the global mean, from (host, path, good)."""
    paths = cut(documents.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("s")), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"),
                                      (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("host_w"), F.count(F.lit(1)).alias("host_paths"))
    both = cut(join_checked(paths, hosts, ["host"], "inner", "site-hosts"), "sites")
    host_mean, mean = F.col("host_s") / F.col("host_n"), F.col("s") / F.col("n")
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s"), F.sum(F.col("host_n") * F.col("host_n")).alias("nn"),
                      F.sum("host_w").alias("w"), F.count(F.lit(1)).alias("hosts"), F.sum("host_paths").alias("paths")).first()
    if not total.n:
        return both, 0.5, 1e6, 1e6
    pi = min(max(total.s / total.n, 1e-6), 1 - 1e-6)
    among = hosts.agg(F.sum(F.col("host_n") * (host_mean - pi) ** 2).alias("x")).first().x
    within = both.agg(F.sum(F.col("n") * (mean - host_mean) ** 2).alias("x"),
                      F.sum(host_mean * (1 - host_mean) / F.col("host_paths") * (F.col("host_paths") - 1)).alias("noise")).first()
    host_k = strength(among, (total.hosts - 1) * pi * (1 - pi), total.n - total.nn / total.n, pi)
    path_k = strength(within.x, within.noise, total.n - total.w, pi)
    return both, pi, host_k, path_k


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """``row``, ``p_quality``, ``p_toxic``, ``p_document`` (its own evidence), ``p_site``, ``posterior`` and ``kept``."""
    models = learn(docs, labels, rows)
    documents = cut(scored(docs, models, keep), "quality-scores")
    own = F.coalesce("p_quality", F.lit(1.0)) * (1 - F.coalesce("p_toxic", F.lit(0.0)))
    documents = documents.withColumn("p_document", F.least(F.greatest(own, F.lit(1e-6)), F.lit(1 - 1e-6)))
    if not models:
        return documents.withColumn("p_site", F.lit(None).cast("double")).withColumn("posterior", F.col("p_document")).withColumn("kept", F.lit(True))
    known = worst(labels).select(F.col("doc_id").alias("id"), F.when(
        F.col("quality").isNotNull() | F.col("toxic").isNotNull(),
        (F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("double").alias("label"))
    # what a document adds to its site's sums: its label, or else its own probability
    documents = join_checked(documents, known, ["id"], "left", "site-labels").withColumn("added", F.coalesce("label", "p_document"))
    sites, pi, host_k, path_k = site_posteriors(documents.select("host", "path", F.col("added").alias("good")))
    joined = join_checked(documents, sites, ["host", "path"], "left", "site-sums")
    me = F.col("p_document")

    def odds(p):
        p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(p / (1 - p))

    host = (F.lit(host_k * pi) + F.col("host_s") - F.col("added")) / (F.lit(host_k) + F.col("host_n") - 1)
    site = F.least(F.greatest((F.lit(path_k) * host + F.col("s") - F.col("added")) / (F.lit(path_k) + F.col("n") - 1), F.lit(1e-6)), F.lit(1 - 1e-6))
    joined = joined.withColumn("p_site", site)
    logit = odds(me) - math.log(pi / (1 - pi)) + odds(F.col("p_site"))
    posterior = 1 / (1 + F.exp(-logit))
    return joined.withColumn("posterior", posterior).withColumn("kept", F.col("posterior") >= threshold)
