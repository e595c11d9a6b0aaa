"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time: every byte position is labelled with the
language of its document. A prediction labels all positions of the whole text, in independent segments of SEGMENT
bytes, and pools the probabilities of the positions into those of the document.

Training uses a bounded sample: at most TRAIN_DOCS documents a language and WINDOWS windows of SEGMENT characters
from each, at places spread over the whole text by a hash. Prediction is one narrow pass without shuffle; memory is
an Arrow batch plus arrays for one block of text.

Defined results
* null text, or text without a letter: language 'und', score 0;
* no labelled document at all: 'und' everywhere; one language only: that one, with score 1;
* ties go to the language that sorts first; rows that repeat an id are predicted one by one;
* a row without id has no remainder: its held_out is null, and it is never learned from;
* empty tables give empty results; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import documents, settled, text_blocks, unused

SEGMENT, HIDDEN = 64, 8
TRAIN_DOCS, WINDOWS, STEPS, BATCH, RATE = 300, 6, 240, 192, 0.02
#: Bytes of text that go through the network at once.
BLOCK = 1 << 18
UNDETERMINED = "und"


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Direction:
    """A gated recurrent layer read in one direction. Arrays are (features, sequences), so gates are contiguous.
    An input byte picks a column of ``inputs``: embedding and input weights in one table."""

    def __init__(self, rng: np.random.Generator, hidden: int, labels: int):
        f = np.float32
        self.p = {
            "inputs": rng.normal(0, 0.3, (3 * hidden, 256)).astype(f),
            "gates": rng.normal(0, 0.3, (2 * hidden, hidden)).astype(f),
            "state": rng.normal(0, 0.3, (hidden, hidden)).astype(f),
            "out": rng.normal(0, 0.3, (labels, hidden)).astype(f),
        }

    def forward(self, x: np.ndarray, order, keep: bool = False):
        """Logits (time, labels, sequences) of the bytes x (time, sequences); with ``keep`` also what training needs."""
        p, hidden = self.p, self.p["state"].shape[0]
        h = np.zeros((hidden, x.shape[1]), np.float32)
        logits, kept = np.empty((x.shape[0], p["out"].shape[0], x.shape[1]), np.float32), []
        for t in order:
            a = np.take(p["inputs"], x[t], axis=1)
            g = a[: 2 * hidden]
            g += p["gates"] @ h
            g = np.clip(g, -30, 30, out=g) if keep else g
            g = sigmoid(g)
            z, r = g[:hidden], g[hidden:]
            u = p["state"] @ h
            n = a[2 * hidden :]
            n += r * u
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            if keep:
                kept.append((t, h, z, r, n, u, new))
            h = new
            np.matmul(p["out"], h, out=logits[t])
        return logits, kept

    def backward(self, x: np.ndarray, kept: list, d_logits: np.ndarray) -> dict[str, np.ndarray]:
        p, hidden = self.p, self.p["state"].shape[0]
        d = {k: np.zeros_like(v) for k, v in p.items()}
        dh = np.zeros((hidden, x.shape[1]), np.float32)
        da = np.empty((3 * hidden, x.shape[1]), np.float32)
        by_byte = np.zeros((256, 3 * hidden), np.float32)
        for t, h, z, r, n, u, new in reversed(kept):
            d["out"] += d_logits[t] @ new.T
            dh = dh + p["out"].T @ d_logits[t]
            dn = dh * (1 - z) * (1 - n * n)
            da[:hidden] = dh * (h - n) * z * (1 - z)
            da[hidden : 2 * hidden] = dn * u * r * (1 - r)
            da[2 * hidden :] = dn
            du = dn * r
            d["gates"] += da[: 2 * hidden] @ h.T
            d["state"] += du @ h.T
            np.add.at(by_byte, x[t], da.T)
            dh = dh * z + p["gates"].T @ da[: 2 * hidden] + p["state"].T @ du
        d["inputs"] = by_byte.T
        return d


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.bias = np.zeros((len(languages), 1), np.float32)
        self.ahead, self.back = (Direction(rng, hidden, len(languages)) for _ in range(2))

    @staticmethod
    def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes (SEGMENT, n), valid length of each segment, row of each segment); the padding is byte 0."""
        lengths = np.diff(offsets)
        per = -(-lengths // SEGMENT)
        row = np.repeat(np.arange(len(lengths)), per)
        place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        start = offsets[:-1][row] + place * SEGMENT
        valid = np.minimum(SEGMENT, offsets[1:][row] - start)
        at = start[None, :] + np.arange(SEGMENT)[:, None]
        x = np.where(np.arange(SEGMENT)[:, None] < valid[None, :], data[np.minimum(at, max(0, len(data) - 1))], 0)
        return x.astype(np.intp), valid, row

    def train(self, segments: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Backpropagation through time with Adam; the loss is the mean cross-entropy of all valid positions."""
        rng = np.random.default_rng(seed)
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in segments])]).astype(np.int64)
        x, valid, row = self.segments(np.frombuffer(b"".join(segments), np.uint8), offsets)
        y = labels[row]
        weight = (1 / np.maximum(1, np.bincount(y, minlength=len(self.languages))))[y]
        params = {"bias": self.bias} | {f"a.{k}": v for k, v in self.ahead.p.items()} | {f"b.{k}": v for k, v in self.back.p.items()}
        m, v = ({k: np.zeros_like(a) for k, a in params.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.choice(len(y), BATCH, p=weight / weight.sum())
            xs, mask = x[:, pick], np.arange(SEGMENT)[:, None] < valid[pick][None, :]
            la, ka = self.ahead.forward(xs, range(SEGMENT), True)
            lb, kb = self.back.forward(xs, range(SEGMENT - 1, -1, -1), True)
            p = la + lb + self.bias
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[:, y[pick], np.arange(BATCH)] -= 1
            p *= (mask / mask.sum())[:, None, :].astype(np.float32)
            grads = {"bias": p.sum(axis=(0, 2))[:, None]} | {f"a.{k}": g for k, g in self.ahead.backward(xs, ka, p).items()} | {f"b.{k}": g for k, g in self.back.backward(xs, kb, p).items()}
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = RATE * min(1, 4 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                params[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean probability, number of positions labelled) of each language for each row."""
        rows, labels = len(offsets) - 1, len(self.languages)
        x, valid, row = self.segments(data, offsets)
        if not len(row):
            return np.zeros((rows, labels)), np.zeros((rows, labels), np.int64)
        logits = self.ahead.forward(x, range(SEGMENT))[0]
        back = self.back.forward(x, range(SEGMENT - 1, -1, -1))[0]
        total, marks = np.zeros((labels, len(row)), np.float32), np.zeros((labels, len(row)), np.float32)
        for t in range(SEGMENT):
            p = logits[t]
            p += back[t]
            p += self.bias
            top = p.max(axis=0)
            inside = (valid > t).astype(np.float32)
            marks += (p >= top) * inside
            p -= top
            np.exp(p, out=p)
            p *= inside / p.sum(axis=0)
            total += p
        prob, seen = np.zeros((rows, labels)), np.zeros((rows, labels))
        for k in range(labels):
            prob[:, k] = np.bincount(row, total[k], rows)
            seen[:, k] = np.bincount(row, marks[k], rows)
        return prob / np.maximum(1, np.diff(offsets))[:, None], seen.astype(np.int64)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, windows: int = WINDOWS, steps: int = STEPS) -> Network | None:
    """Train on a bounded, hash-chosen sample: at most ``train_docs`` rows a language, ``windows`` windows a row.

    Two aggregates choose the sample, and only its windows come to the driver."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).withColumn("k", F.xxhash64("i"))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    spark = labelled.sparkSession
    share = spark.createDataFrame([(lang, min(1.0, 3 * train_docs / n)) for lang, n in counts.items()], "l string, share double")
    thin = rows.join(F.broadcast(share), "l").where(F.pmod("k", F.lit(1_000_000)) < F.col("share") * 1_000_000)
    span = F.greatest(F.length("t") - SEGMENT, F.lit(0)) + 1
    cut = F.transform(F.sequence(F.lit(1), F.lit(windows)), lambda j: F.col("t").substr((F.pmod(F.xxhash64("k", j), span) + 1).cast("int"), F.lit(SEGMENT)))
    some = thin.where("t IS NOT NULL").select("l", "k", "i", cut.alias("cut")).withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("k", "i"))).where(F.col("r") <= train_docs)
    sample = sorted(((r.l, r.k, r.cut) for r in some.collect()), key=lambda r: (r[0], r[1]))
    languages = sorted(counts)
    net = Network(languages)
    parts = [(languages.index(lang), s.encode()[:SEGMENT]) for lang, _, cut in sample for s in cut if s]
    if len(languages) > 1 and parts:
        net.train([s for _, s in parts], np.array([k for k, _ in parts]), steps)
    return net


def predict(df: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, lang_probs, lang_positions): the pooled probabilities and the number of positions
    labelled with each language, for the whole text. With ``keep``: all columns of the rows, and the language in a column of that name."""
    out = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_probs", T.MapType(T.StringType(), T.DoubleType())), T.StructField("lang_positions", T.MapType(T.StringType(), T.LongType()))]
    if keep:
        schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in df.schema], T.StructField(keep, T.StringType())])
    else:
        schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), *out])
    names = net.languages if net else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_blocks(batch.column(0), BLOCK):
                n = hi - lo
                prob, seen = net.pooled(data, offsets) if net else (np.zeros((n, 0)), np.zeros((n, 0), np.int64))
                known = letters[lo:hi].astype(bool) & (len(names) > 0)
                best = prob.argmax(axis=1) if names else np.zeros(n, int)
                lang = pa.array([names[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], pa.string())
                rest = [c.slice(lo, n) for c in batch.columns[2:]]
                if keep:
                    yield pa.RecordBatch.from_arrays([*rest, lang], schema.names)
                    continue
                score = np.where(known, prob.max(axis=1) if names else 0.0, 0.0)
                keys, offs = pa.array(names * n, pa.string()), pa.array(np.arange(n + 1) * len(names), pa.int32())
                maps = [pa.MapArray.from_arrays(offs, keys, pa.array(a.reshape(-1), t)) for a, t in ((prob, pa.float64()), (seen, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*rest, lang, pa.array(np.clip(score, 0, 1)), *maps], schema.names)

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    carried = [F.col(f"`{c}`") for c in df.columns] if keep else [F.col(id_col).alias("doc_id")]
    return df.select(F.col(text_col).alias(unused(df, "_text")), letter.alias(unused(df, "_letter")), *carried).mapInArrow(settled(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = fit(docs.where(~held_out()))
    return predict(docs, net).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "lang_probs", "lang_positions")
