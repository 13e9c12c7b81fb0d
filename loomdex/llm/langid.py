"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior per row: the text under byte-trigram
models, the language that the markup declares, the language that the address
names (country suffix or first path part), and a prior of the host. Host priors are
Dirichlet-smoothed along host, domain and everything: soft counts of text posteriors are
summed by host and by domain, and each level leans on the one above by `STRENGTH`
pseudo-rows. Beside the trained languages stands "und", a uniform model, for text
in none of them.

Trigram models are fitted on a bounded sample of each language's labelled rows
(`SAMPLE`, the first by hash of the id), counted by Spark; a model has `FEATURES` hashed
trigrams a language whatever the data. Of markup, only text outside tags, comments,
scripts and styles is evidence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.shared import cut

from .html_template import visible_text
from .tokens import LOWER, text_slices

SAMPLE = 4000
FEATURES = 1 << 14
UNKNOWN = "und"
#: Trigrams that count as independent observations at most: longer texts don't drown the rest.
EVIDENCE = 200
STRENGTH = 20.0
UNKNOWN_PRIOR = 1e-4
MARKUP_TRUST, ADDRESS_TRUST = 0.8, 0.6
#: Sampled rows that are broadcast at most.
BROADCAST_IDS = 200_000
#: Priors of at most this many hosts are broadcast (about 100 bytes each); more are joined by host.
BROADCAST_HOSTS = 20_000

# ASCII other than letters is one separator
_SOUND = LOWER.copy()
_SOUND[[b for b in range(128) if not 97 <= LOWER[b] <= 122]] = 32


def _trigrams(data: np.ndarray, offsets: np.ndarray):
    """Hashed trigrams of a slice, with their texts; none across texts or of separators alone."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sound = _SOUND[data].astype(np.uint32)
    h = sound[:-2] * np.uint32(0x9E3779B1) + sound[1:-1] * np.uint32(0x85EBCA77) + sound[2:] * np.uint32(0xC2B2AE3D)
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - FEATURES.bit_length() + 1)
    ok = (sound[:-2] != 32) | (sound[1:-1] != 32)
    ok &= (sound[1:-1] != 32) | (sound[2:] != 32)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok &= text[:-2] == text[2:]
    return h[ok].astype(np.int64), text[:-2][ok]


def _count_rows(languages: list[str]):
    place = {name: i for i, name in enumerate(languages)}

    def rows(batches):
        total = np.zeros(len(languages) * FEATURES, np.int64)
        for batch in batches:
            label = np.array([place.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
            for at, n, data, offsets in text_slices(batch.column("text")):
                h, text = _trigrams(data, offsets)
                own = label[at : at + n][text]
                total += np.bincount(own[own >= 0] * FEATURES + h[own >= 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["feature", "n"])

    return rows


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (a row a language, the last for "und") from at most `sample` labelled rows of each; rows without id, text or label teach nothing."""
    rows = labelled.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    keyed = rows.select(F.col(id_col).alias("__chosen"), F.col(lang_col).alias("__lang"), F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 1).alias("h"))
    # only hashes below a bound, which twice the sample is expected to have, are ranked: no language is one task
    sizes = keyed.groupBy("__lang").agg(F.approx_count_distinct("h").alias("n"))
    low = keyed.join(F.broadcast(sizes), "__lang").where(F.col("h") <= F.lit(2.0**63) * (2 * sample + 100) / F.col("n")).dropDuplicates(["__lang", "__chosen"])
    place = F.row_number().over(Window.partitionBy("__lang").orderBy("h", "__chosen"))
    chosen = cut(low.withColumn("place", place).where(F.col("place") <= sample).select("__chosen", "__lang"))
    names = sorted(r[0] for r in chosen.select("__lang").distinct().collect())
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    picked = rows.join(chosen, (F.col(id_col) == F.col("__chosen")) & (F.col(lang_col) == F.col("__lang"))).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = np.zeros((len(names) + 1, FEATURES))
    if names:
        summed = picked.mapInArrow(_count_rows(names), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
        counts.ravel()[summed["feature"].to_numpy()] = summed["n"].to_numpy()
    counts += 0.5
    return [*names, UNKNOWN], np.log(counts / counts.sum(axis=1, keepdims=True))


def _likelihood_rows(broadcast, markup: bool, keep: list[str]):
    def rows(batches):
        model = broadcast.value.astype(np.float32)
        for batch in batches:
            at_rows = []
            texts = batch.column("__text")
            if markup:
                texts = pa.array([visible_text(x or "") for x in texts.to_pylist()], pa.string())
            for _, n, data, offsets in text_slices(texts):
                h, text = _trigrams(data, offsets)
                out = np.zeros((n, len(model)))
                if len(h):
                    heads = np.searchsorted(text, np.arange(n))
                    filled = np.flatnonzero(np.diff(np.append(heads, len(h))))
                    sizes = np.diff(np.append(heads, len(h)))[filled]
                    for i, row in enumerate(model):
                        out[filled, i] = np.add.reduceat(row[h].astype(np.float64), heads[filled]) * np.minimum(1, EVIDENCE / sizes)
                at_rows.append(out)
            out = np.concatenate(at_rows) if at_rows else np.zeros((0, len(model)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, len(model)), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "text_evidence"])

    return rows


def _normalised(logs):
    """Probabilities of an array of logs."""
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))


def _plus(*arrays):
    total = arrays[0]
    for other in arrays[1:]:
        total = F.zip_with(total, other, lambda a, b: a + b)
    return total


def _declared_evidence(code, languages: list[str], trust: float):
    """Log-likelihoods of a declared language code; none if it is missing or unknown."""
    n, names = len(languages), F.array(*[F.lit(x) for x in languages])
    told = F.transform(names, lambda x: F.log(F.when(x == code, F.lit(trust)).otherwise(F.lit((1 - trust) / max(1, n - 1)))))
    return F.when(F.array_contains(names, code), told).otherwise(F.array_repeat(F.lit(0.0), n))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", host=None, markup_lang=None, address_lang=None, markup: bool = False, keep_text: bool = False) -> DataFrame:
    """Rows with language, confidence and text_language (from the text alone).

    `host`, `markup_lang` and `address_lang` are columns, null or None where there is no
    such evidence; with `markup` the text is html. Empty and null texts are judged by
    the other evidence. The text column is dropped unless `keep_text`; input columns
    of the three names are replaced. Repeated rows each count in their host's prior.

    Texts are read twice, for the priors and for the posteriors, and never shuffled
    unless there are more than `BROADCAST_HOSTS` hosts.
    """
    languages, logs = model
    n = len(languages)
    new = ("language", "confidence", "text_language")
    rest = [c for c in rows.columns if c not in (*new, text_col)]
    null = F.lit(None).cast("string")
    evidence = [F.coalesce(x if x is not None else null, F.lit("")).alias(name) for x, name in ((host, "host"), (markup_lang, "markup"), (address_lang, "address"))]
    known = rows.select(F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in rest]).alias("__row"), *evidence, F.col(f"`{text_col}`").alias("__text"))
    types = {"__row": known.schema["__row"].dataType.simpleString(), "__text": "string", "host": "string", "markup": "string", "address": "string"}
    weights = rows.sparkSession.sparkContext.broadcast(logs)

    def judged(keep: list[str]) -> DataFrame:
        shape = ", ".join([*(f"{c} {types[c]}" for c in keep), "text_evidence array<double>"])
        return known.select(*dict.fromkeys([*keep, "__text"])).mapInArrow(_likelihood_rows(weights, markup, keep), shape)

    flat = [UNKNOWN_PRIOR if x == UNKNOWN else (1 - UNKNOWN_PRIOR) / max(1, n - 1) for x in languages]
    prior = F.array(*[F.lit(float(np.log(x))) for x in flat])
    soft = _normalised(_plus(F.col("text_evidence"), prior))
    counts = judged(["host"]).select("host", soft.alias("p"))
    by_host = counts.groupBy("host").agg(*[F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)])
    by_host = by_host.withColumn("s_all", sum(F.col(f"s{i}") for i in range(n)))
    by_host = cut(by_host.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)))
    totals = lambda name: [F.sum(f"s{i}").alias(f"{name}{i}") for i in [*range(n), "_all"]]
    by_domain, overall = by_host.groupBy("domain").agg(*totals("d")), by_host.agg(*totals("a"))
    lean = lambda own, above: [(F.col(f"{own}{i}") + STRENGTH * above[i]) / (F.col(f"{own}_all") + STRENGTH) for i in range(n)]
    hosts = by_host.join(by_domain, "domain").crossJoin(F.broadcast(overall))
    host_prior = lean("s", lean("d", lean("a", [F.lit(x) for x in flat])))
    hosts = hosts.select(F.col("host").alias("h"), F.array(*[F.log(F.greatest(x, F.lit(1e-12))) for x in host_prior]).alias("host_prior"))
    if by_host.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)

    fused = judged(["__row", *["__text"] * keep_text, "host", "markup", "address"]).join(hosts, F.col("host") == F.col("h"))
    p = _normalised(_plus(F.col("text_evidence"), F.col("host_prior"), _declared_evidence(F.col("markup"), languages, MARKUP_TRUST), _declared_evidence(F.col("address"), languages, ADDRESS_TRUST)))
    fused = fused.withColumns({"p": p, "soft": soft})
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    out = [F.col("__text").alias(c) if c == text_col else F.col(f"__row.`{c}`") for c in rows.columns if c in rest or (keep_text and c == text_col)]
    return fused.select(*out, best(F.col("p")).alias("language"), F.array_max("p").alias("confidence"), best(F.col("soft")).alias("text_language"))
