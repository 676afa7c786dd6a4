"""Language identification by a byte convolutional network, trained here in numpy.

Bytes fall into 128 symbols; filters of several widths slide over windows of fixed length, each
filter keeps its largest response in the window (max pooling), and a softmax layer turns the
responses into language probabilities.  A document's probabilities are the mean over all its
windows, weighted by their bytes.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm import textkernel as tk

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
PAD, SYMBOLS, UNKNOWN = 0, 128, "und"


def _symbols() -> np.ndarray:
    lut = np.empty(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            lut[b] = 95 + (b - 0xC0) % 33
        elif b >= 0x80:
            lut[b] = 31 + b - 0x80
        elif c.isalpha():
            lut[b] = 5 + ord(c.lower()) - ord("a")
        else:
            lut[b] = 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isprintable() else 4
    return lut


_LUT = _symbols()


def windows(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of every window, its row, its bytes) of a string column; the last window of a text is padded.

    Windows are as wide as WINDOW plus padding for the widest filter.  An empty text has none.
    """
    return _windows(*tk.raw_buffers(col))


def _windows(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.diff(off)
    count = -(-n // WINDOW)
    row = np.repeat(np.arange(len(n)), count)
    flat = np.zeros(int(count.sum()) * WINDOW, np.uint8)
    base = (np.cumsum(count) - count) * WINDOW
    flat[np.arange(len(raw)) + np.repeat(base - off[:-1], n)] = _LUT[raw]
    out = np.zeros((len(row), WINDOW + max(WIDTHS) - 1), np.uint8)
    out[:, :WINDOW] = flat.reshape(-1, WINDOW)
    size = np.full(len(row), WINDOW, np.int64)
    size[np.cumsum(count)[count > 0] - 1] = (n - (count - 1) * WINDOW)[count > 0]
    return out, row, size


class ByteConvNet:
    """Weights: conv[w][offset, symbol, filter] with bias[w], and the softmax layer out, out_bias."""

    def __init__(self, classes: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.classes = list(classes)
        self.conv = [(r.standard_normal((w, SYMBOLS, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (r.standard_normal((FILTERS * len(WIDTHS), len(classes))) * 0.1).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def params(self) -> list[np.ndarray]:
        return [*self.conv, *self.bias, self.out, self.out_bias]

    def _responses(self, x: np.ndarray) -> list[np.ndarray]:
        """Filter responses [window, position, filter] by width, from tables over pairs of symbols."""
        if self._tables is None:
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
            self._tables = []
            for c, b in zip(self.conv, self.bias):
                parts = [pair(c[k], c[k + 1]) for k in range(0, len(c) - 1, 2)] + ([c[-1]] if len(c) % 2 else [])
                parts[0] = parts[0] + b
                self._tables.append([np.ascontiguousarray(p) for p in parts])
        two = x[:, :-1].astype(np.intp) * SYMBOLS + x[:, 1:]
        out = []
        for w, parts in zip(WIDTHS, self._tables):
            z = None
            for k, table in enumerate(parts):
                at = two[:, 2 * k : 2 * k + WINDOW] if len(table) > SYMBOLS else x[:, 2 * k : 2 * k + WINDOW]
                z = table.take(at, 0) if z is None else np.add(z, table.take(at, 0), out=z)
            out.append(z)
        return out

    def pooled(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum(z.max(1), 0) for z in self._responses(x)], 1)

    def probabilities(self, x: np.ndarray, batch: int = 64) -> np.ndarray:
        out = np.empty((len(x), len(self.classes)), np.float32)
        for at in range(0, len(x), batch):
            z = self.pooled(x[at : at + batch]) @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            out[at : at + batch] = z / z.sum(1, keepdims=True)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 4e-3, batch: int = 64, seed: int = 11) -> "ByteConvNet":
        """Adam on the cross-entropy.  Only the position at which a filter is largest gets its gradient."""
        r = np.random.default_rng(seed)
        m = [np.zeros_like(p) for p in self.params()]
        v = [np.zeros_like(p) for p in self.params()]
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                own = order[at : at + batch]
                xb, yb = x[own], y[own]
                self._tables = None if at % (8 * batch) == 0 else self._tables
                z, where = [], []
                for width, c, b in zip(WIDTHS, self.conv, self.bias):
                    a = b + sum(c[k].take(xb[:, k : k + WINDOW], 0) for k in range(width))
                    p = a.argmax(1)
                    where.append(p)
                    z.append(np.take_along_axis(a, p[:, None, :], 1)[:, 0])
                h = np.maximum(np.concatenate(z, 1), 0)
                s = h @ self.out + self.out_bias
                s = np.exp(s - s.max(1, keepdims=True))
                s /= s.sum(1, keepdims=True)
                s[np.arange(len(yb)), yb] -= 1
                s /= len(yb)
                gh = (s @ self.out.T) * (h > 0)
                g_conv, g_bias = [], []
                for i, (width, p) in enumerate(zip(WIDTHS, where)):
                    g = gh[:, i * FILTERS : (i + 1) * FILTERS]
                    gc = np.zeros_like(self.conv[i])
                    for k in range(width):
                        np.add.at(gc[k], (np.take_along_axis(xb, p + k, 1), np.arange(FILTERS)[None, :]), g)
                    g_conv.append(gc)
                    g_bias.append(g.sum(0))
                step += 1
                for p, g, mm, vv in zip(self.params(), [*g_conv, *g_bias, h.T @ s, s.sum(0)], m, v):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    p -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        self._tables = None
        return self


def _training_windows(texts: list[str], labels: list[int], other: int, per_text: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to per_text windows of a text, half of them cut short at random, and a share of strings that are no language."""
    r = np.random.default_rng(seed)
    pieces, y = [], []
    for text, label in zip(texts, labels):
        b = text.encode()
        for k in range(min(per_text, 1 + len(b) // WINDOW)):
            at = int(r.integers(0, max(1, len(b) - WINDOW + 1)))
            n = int(r.integers(3, 128)) if k % 2 else WINDOW
            pieces.append(b[at : at + n])
            y.append(label)
    kinds = [b"0123456789", b"0123456789abcdef", b"!#$%&*+-/:;<=>?@[]^_|~", bytes(range(1, 256)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    for k in range(len(pieces) // 20 + 20):
        pieces.append(bytes(r.choice(np.frombuffer(kinds[k % len(kinds)], np.uint8), int(r.integers(8, WINDOW)))))
        y.append(other)
    x = np.zeros((len(pieces), WINDOW + max(WIDTHS) - 1), np.uint8)
    for i, p in enumerate(pieces):
        x[i, : len(p)] = _LUT[np.frombuffer(p, np.uint8)]
    return x, np.array(y)


def train(docs: DataFrame, *, max_rows: int = 3000, per_text: int = 3, steps: int = 800, seed: int = 7, text_col: str = "text", label_col: str = "lang") -> ByteConvNet:
    """Fits the network on a sample of labelled texts, on the driver.

    The sample has max_rows / labels texts of each label (one at least), those of the least hash among its
    different texts, so that every label becomes a class and copies take no place.  Only hashes are shuffled
    to find them.  Rows without text or label are left out.  The class "und" is trained on strings of
    digits, symbols and random bytes; without any labelled row it is the only class.  Of a very long text
    a few windows are used, at random places of all of it.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where("length(text) > 0 and label is not null")
    rows = rows.withColumn("h", F.xxhash64("text", "label"))
    labels = docs.select(F.col(label_col).cast("string").alias("label")).dropna().distinct().count()
    each = max(1, max_rows // max(1, labels))
    first = rows.select("label", "h").distinct().withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("k") <= each)
    most = {r["label"]: r["h"] for r in first.groupBy("label").agg(F.max("h").alias("h")).collect()}
    held = docs.sparkSession.createDataFrame(sorted(most.items()), "of string, most long")
    rows = rows.join(F.broadcast(held), (F.col("label") == F.col("of")) & (F.col("h") <= F.col("most"))).groupBy("h", "label").agg(F.min("text").alias("text")).orderBy("h", "label").collect()
    classes = sorted({r["label"] for r in rows} | {UNKNOWN})
    x, y = _training_windows([r["text"] for r in rows], [classes.index(r["label"]) for r in rows], classes.index(UNKNOWN), per_text, seed)
    return ByteConvNet(classes, seed).fit(x, y, max(1, round(steps * 64 / len(x))))


def scores(net: ByteConvNet, col: pa.Array) -> np.ndarray:
    """Mean class probabilities of every row over all its windows, by bytes; rows of zeros for empty texts."""
    out = np.zeros((len(col), len(net.classes)))
    for at, part in tk.slices(col):
        raw, off = tk.raw_buffers(part)
        for a in range(0, max(1, len(raw)), tk.SLICE_BYTES):  # a text of more than a slice goes a slice at a time
            x, row, size = _windows(raw[a : a + tk.SLICE_BYTES], np.clip(off - a, 0, tk.SLICE_BYTES) if len(part) == 1 else off)
            p = net.probabilities(x) * size[:, None]
            for c in range(len(net.classes)):
                out[at : at + len(part), c] += np.bincount(row, p[:, c], minlength=len(part))
    total = out.sum(1, keepdims=True)
    return out / np.where(total > 0, total, 1)


def identify(docs: DataFrame, net: ByteConvNet, *, min_confidence: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs with lang_id (language, confidence, accepted).

    accepted: the likeliest class is a language, and its probability at least min_confidence.

    Defined cases: a null or empty text is of class "und", with confidence 0, and not accepted; a very long
    text is read whole, a slice at a time; of classes that are equally likely the first by name is taken;
    repeated rows are answered each; an empty table stays empty; the columns of docs stay as they are, but
    one of theirs named lang_id is replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model.value
        names = np.array(own.classes, object)
        for col in batches:
            p = scores(own, col)
            best, top = names[p.argmax(1)], p.max(1)
            best[top == 0] = UNKNOWN
            yield pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(np.round(top, 6)), pa.array((best != UNKNOWN) & (top >= min_confidence))], ["language", "confidence", "accepted"])

    udf = F.arrow_udf(run, "struct<language string, confidence double, accepted boolean>")
    return docs.withColumn("lang_id", udf(F.col(text_col)))
