"""Language identification by fusing evidence.

For each language the log posterior adds up

- the likelihood of the text: byte trigrams, hashed, against counts of text that
  declares the language (tempered, as neighbouring trigrams overlap);
- the declared markup language and the address suffix: how often text of the
  language carries them, counted over the corpus;
- the host's prior: language shares of the host, smoothed towards those of its
  parent domain (or, with one label, of the corpus), and these towards those of
  the corpus, by grouped counts.

Evidence that is missing says nothing. A flat model stands for text in no language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binroute.sources.scratch import materialize

from .columns import flat, mix, row_sums, set_aside, slices, texts

LANGUAGES = ("en", "fr", "de", "es")
BITS = 16
#: Exponent of the text likelihood and bits per trigram of the flat model.
TEMPER, FLAT_BITS = 1 / 3, 15.0
#: Weight, in texts, of a parent's shares against a child's counts.
PARENT_WEIGHT = 10.0
LEAST_POSTERIOR = 0.5


def trigrams(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each row, and where rows begin; letters count without ASCII case."""
    data, bounds = flat(column)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64)
    upper = (data >= 65) & (data <= 90)
    low = np.where(upper, data | 32, np.where(data < 65, 32, data)).astype(np.uint32)
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    buckets = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)
    inside = np.zeros(len(data) - 2, bool)
    counts = np.maximum(np.diff(bounds) - 2, 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    inside[np.repeat(bounds[:-1], counts) + np.arange(first[-1]) - np.repeat(first[:-1], counts)] = True
    return buckets[inside], first


def count_trigrams(texts_by_language: DataFrame, languages: tuple[str, ...], bits: int = BITS) -> DataFrame:
    """``(bucket, n)`` with a count per language, over all rows of ``(text, declared)``."""
    size, names = 1 << bits, [f"n{i}" for i in range(len(languages))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(languages), size), np.int64)
        for batch in batches:
            column = texts(batch.column(0))
            which = batch.column(1).to_numpy(zero_copy_only=False)
            for start, stop in slices(column):
                buckets, first = trigrams(column[start:stop], bits)
                row_of = np.repeat(which[start:stop], np.diff(first))
                for at in range(len(languages)):
                    totals[at] += np.bincount(buckets[row_of == at], minlength=size)
        some = np.flatnonzero(totals.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(t[some]) for t in totals)], names=["bucket", *names])

    index = F.coalesce(F.array_position(F.lit(list(languages)), F.col("declared")) - 1, F.lit(-1)).cast("int")
    counted = texts_by_language.select("text", index.alias("which")).where("which >= 0")
    schema = "bucket long, " + ", ".join(f"{n} long" for n in names)
    return counted.mapInArrow(run, schema).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])


def likelihood_table(counts: DataFrame, languages: tuple[str, ...], bits: int = BITS) -> np.ndarray:
    """Log likelihood per bucket and language, the flat model last; ``2^bits`` rows on the driver."""
    found = np.zeros((1 << bits, len(languages)))
    for row in counts.collect():
        found[row["bucket"]] = [row[f"n{i}"] for i in range(len(languages))]
    smooth = found + 0.01
    table = np.log(smooth / smooth.sum(axis=0))
    return np.hstack([table, np.full((len(table), 1), -FLAT_BITS * np.log(2))]).astype(np.float32)


def log_likelihoods(table: np.ndarray, text: Column, bits: int = BITS) -> Column:
    """Tempered log likelihood of a text per language and for the flat model; zeros without trigrams."""

    @F.arrow_udf("array<double>")
    def score(column: pa.Array) -> pa.Array:
        column = texts(column)
        out = [np.zeros((0, table.shape[1]))]
        for start, stop in slices(column):
            buckets, first = trigrams(column[start:stop], bits)
            out.append(row_sums(table[buckets], first) * TEMPER)
        flat_out = np.round(np.concatenate(out), 6)
        ends = pa.array(np.arange(len(column) + 1, dtype=np.int32) * table.shape[1])
        return pa.ListArray.from_arrays(ends, pa.array(flat_out.reshape(-1)))

    return score(text)


def best(scores: Column, languages: tuple[str, ...]) -> Column:
    """The class with the highest score; the first of equals, ``und`` for the flat model."""
    return F.element_at(F.lit([*languages, "und"]), F.array_position(scores, F.array_max(scores)).cast("int"))


def domain_of(host: Column) -> Column:
    """The last two labels of a host name; null for a name of one label, whose parent is the corpus."""
    return F.when(host.contains("."), F.substring_index(host, ".", -2))


@dataclass
class Weights:
    """Evidence weights per value of a signal, as a written table ``(__value, __weights)``."""

    table: DataFrame

    def get(self, value: str | None, default: list[float] | None = None) -> list[float] | None:
        row = self.table.where(F.col("__value") == F.lit(value)).first()
        return list(row["__weights"]) if row else default


@dataclass
class Model:
    """Fitted evidence: a likelihood table, evidence weights per value, and priors per host as a table."""

    table: np.ndarray
    languages: tuple[str, ...]
    signals: dict[str, Weights]
    corpus: list[float]
    hosts: DataFrame

    def posterior(self, rows: DataFrame, likelihoods: Column | None = None) -> DataFrame:
        """``rows`` with ``scores``, the posterior of each language and of ``und``, summing to 1.

        ``rows`` has ``__text, __declared, __suffix, __host``. The join with the
        hosts' priors and with the signals' weights is left to Spark: broadcast if the written table is small,
        else a shuffle that adaptive execution can split at a hot host.
        """
        total = log_likelihoods(self.table, F.col("__text")) if likelihoods is None else likelihoods
        joined = rows.withColumn("__fit", total).join(self.hosts, F.col("__host") == F.col("__host_name"), "left")
        parts = [F.coalesce(F.col("__prior"), F.lit(self.corpus))]
        for signal, weights in self.signals.items():
            own = weights.table.withColumnsRenamed({"__value": f"__{signal}_value", "__weights": f"__{signal}_weights"})
            joined = joined.join(own, F.col(f"__{signal}") == F.col(f"__{signal}_value"), "left")
            parts.append(F.coalesce(F.col(f"__{signal}_weights"), F.lit([0.0] * len(self.corpus))))
        sums = F.col("__fit")
        for part in parts:
            sums = F.zip_with(sums, part, lambda x, y: x + y)
        scored = joined.withColumn("__sums", sums)
        used = [f"__{signal}_{part}" for signal in self.signals for part in ("value", "weights")]
        top = F.array_max("__sums")
        weights = scored.withColumn("__odds", F.transform("__sums", lambda s: F.exp(s - top)))
        whole = F.aggregate("__odds", F.lit(0.0), lambda a, b: a + b)
        return weights.withColumn("scores", F.transform("__odds", lambda o: o / whole)).drop("__fit", "__prior", "__host_name", "__sums", "__odds", *used)


def evidence(docs: DataFrame, text: Column, declared: Column | None = None, suffix: Column | None = None, host: Column | None = None) -> DataFrame:
    """``docs`` with the columns the model reads; what is missing is null."""
    null = F.lit(None).cast("string")
    primary = F.lower(F.substring_index(declared, "-", 1)) if declared is not None else null
    return docs.withColumns({
        "__text": F.coalesce(text, F.lit("")),
        "__declared": primary,
        "__suffix": F.lower(suffix) if suffix is not None else null,
        "__host": F.lower(host) if host is not None else null,
    })


def _shares(counts: list[Column], parent: list[Column]) -> list[Column]:
    whole = sum(counts[1:], counts[0])
    return [(n + PARENT_WEIGHT * p) / (whole + PARENT_WEIGHT) for n, p in zip(counts, parent, strict=True)]


def fit(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> Model:
    """Count trigrams, signals and hosts over all rows with the evidence columns.

    Declared languages label the trigram counts. What a signal says, and the
    shares of hosts, are counted on the language that the text alone suggests.
    Every value of a signal has weights, smoothed towards the corpus, so that rare
    ones say little; unseen ones say nothing about the language.
    """
    counts = count_trigrams(rows.select(F.col("__text").alias("text"), F.col("__declared").alias("declared")), languages)
    table = likelihood_table(counts, languages)
    classes = [*languages, "und"]
    guessed = materialize(
        rows.select(
            "__declared", "__suffix", "__host", best(log_likelihoods(table, F.col("__text")), languages).alias("guess")
        ).groupBy("__declared", "__suffix", "__host", "guess").count(),
        "language-evidence",
    )
    by_class = [F.sum(F.when(F.col("guess") == c, F.col("count")).otherwise(0)).cast("double").alias(f"c{i}") for i, c in enumerate(classes)]
    names = [f"c{i}" for i in range(len(classes))]
    total = guessed.agg(*by_class).first()
    total = np.array([total[n] or 0.0 for n in names])
    corpus = (total + 1) / (total + 1).sum()
    signals = {}
    for signal in ("declared", "suffix"):
        seen = guessed.where(F.col(f"__{signal}").isNotNull()).groupBy(F.col(f"__{signal}").alias("value")).agg(*by_class)
        ratios = [F.log((F.col(n) + len(names) * float(x)) / float(x)) for n, x in zip(names, corpus, strict=True)]
        mean = sum(ratios[1:], ratios[0]) / len(ratios)
        weights = F.array(*[r - mean for r in ratios])
        signals[signal] = Weights(materialize(seen.select(F.col("value").alias("__value"), weights.alias("__weights")), f"language-{signal}"))
    hosts = guessed.where("__host IS NOT NULL").groupBy(F.col("__host").alias("__host_name")).agg(*by_class)
    hosts = materialize(hosts.withColumn("domain", domain_of(F.col("__host_name"))), "language-hosts")
    parents = hosts.where("domain IS NOT NULL").groupBy("domain").agg(*[F.sum(n).alias(f"p{n}") for n in names])
    top = [F.lit(float(x)) for x in corpus]
    parent = [F.coalesce(p, x) for p, x in zip(_shares([F.col(f"p{n}") for n in names], top), top, strict=True)]
    joined = hosts.join(parents, "domain", "left")
    prior = F.array(*[F.log(s) for s in _shares([F.col(n) for n in names], parent)])
    priors = materialize(joined.select("__host_name", prior.alias("__prior")), "language-priors")
    return Model(table, languages, signals, [float(np.log(x)) for x in corpus], priors)


def identify(rows: DataFrame, model: Model, accepted: tuple[str, ...] | None = None, least: float = LEAST_POSTERIOR) -> DataFrame:
    """``rows`` with ``language``, ``posterior`` and ``kept``.

    A text is kept if its best class is an accepted language with at least ``least``
    posterior; one without any letter or digit has language ``und`` and is rejected.
    Ties go to the earlier language. Rows keep their number, repeated ones too. Other
    columns stay; those named like a result give way to it.
    """
    rows, back = set_aside(rows.drop("language", "posterior", "kept"), ["__text", "__declared", "__suffix", "__host"])
    scored = model.posterior(rows)
    bare = ~F.col("__text").rlike(r"[\p{L}\p{N}]")
    language = F.when(bare, "und").otherwise(best(F.col("scores"), model.languages))
    result = scored.withColumns({"language": language, "posterior": F.round(F.array_max("scores"), 6)})
    kept = F.col("language").isin(*(accepted or model.languages)) & (F.col("posterior") >= least)
    return back(result, "language", "posterior", kept.alias("kept")).drop("__text", "__declared", "__suffix", "__host")


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Evidence of web pages: visible text, ``lang`` of the markup, host, and the last label of the host."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)", 1)
    lang = F.regexp_extract(html, r"""(?is)<html[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&#?\w+;", " ")
    known = F.when(host != "", host)
    return evidence(pages, text, F.when(lang != "", lang), F.substring_index(known, ".", -1), known)


def document_evidence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", host_col: str = "source") -> DataFrame:
    """Evidence of documents: their declared language, and their source in the host's place."""
    return evidence(docs, F.col(text_col), F.col(lang_col), None, F.col(host_col))
