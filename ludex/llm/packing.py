"""Mixture-controlled packing: deficit round-robin over source queues.

Every document becomes its token ids and an end id, appended to the queue of
its source.  Windows of ``size`` tokens are filled from all queues in a fixed
order at target proportions; what rounding denies a queue in one window is its
deficit and is granted in a later one.  With weights w_s (W in total, prefix
sums c_s) the deficits have a closed form: before window j queue s has sent
floor(j size c_s / W) - floor(j size c_{s-1} / W) tokens, so every window is
full, no queue is ever more than one token off its target, and each document
finds its windows from its own queue position: the deficits cross windows and
partitions without a sequential pass.  When a queue runs dry the window in
which that happens is granted explicitly and the rest goes on with the
remaining queues; only the last window of all can be short.

Proportions default to the share of tokens that each source holds (quantised to
1/65536), so all queues last to the end.  The order in a queue is that of the
written token stage.  The driver sees one row per source: a source is a queue
of the mixture, so their number is a setting, not data; the hot source is
spread over all tasks like any other, as nothing is grouped by source but sums.

A worker remembers the ids of short pieces in at most ``CACHE_BYTES`` (twice, with
the generation before); texts are taken ``CHUNK_CHARS`` bytes at once, ids ``IDS_BYTES``
at once, and freed memory is given back when a task ends.  A very long text
without blanks is one piece, encoded whole and not remembered.

Null texts are empty documents (the end id alone), null sources are a queue of
their own, repeated ids are packed one by one, an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ludex.llm.common import byte_slices, col, giving_back, stage

SIZE = 4096
END_ID = 2                # fixed value: id after each document
SCALE = 1 << 16
CACHE_BYTES = 28 << 20    # of a worker's memory of pieces, and of the generation before it
CACHE_PIECE = 64          # longer pieces are not remembered
CACHE_SEEN = 1 << 21      # places of the filter that keeps pieces out that came once
CHUNK_CHARS = 4 << 20
IDS_BYTES = 4 << 20       # ids that are cut at once


# Bytes as the printable characters that byte-level vocabularies use: printable Latin-1 stands for itself, the rest from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = "".join(chr(b) if b in _PRINTABLE else chr(0x100 + sum(x not in _PRINTABLE for x in range(b))) for b in range(256))
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")


# Below U+0250: 1 full stop and comma, 0 letters, digits and blanks, 2 the rest.
_KIND = np.array([1 if chr(c) in ".," else 0 if (chr(c).isalpha() and c != 0x130) or chr(c) in "0123456789 \n" else 2 for c in range(0x250)], np.uint8)


class _Pieces(dict):
    """Blank-separated pieces -> ids, filled when a piece comes again; the last two generations of ``CACHE_BYTES`` are kept."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old, self.held, self.seen, self.once = make, {}, 0, bytearray(CACHE_SEEN), 0

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.make(piece)
            place = hash(piece) % CACHE_SEEN
            if not self.seen[place]:                         # most different pieces come once
                self.seen[place], self.once = 1, self.once + 1
                if 2 * self.once > CACHE_SEEN:
                    self.seen, self.once = bytearray(CACHE_SEEN), 0
                return got
        if len(piece) <= CACHE_PIECE:
            size = 200 + len(piece) + len(got)               # with the two objects and their place
            if self.held + size > CACHE_BYTES:
                self.old, self.held = dict(self), 0
                self.clear()
            self.held += size
            self[piece] = got
        return got


class WordTokenizer:
    """``Tokenizer.encode(text, add_special_tokens=False)`` for a lower-casing BPE with word ends that drops white space.

    The tokenizer works inside blank-separated pieces, so pieces are remembered.  A
    piece of Latin letters with ASCII marks around them is two or three of its
    words, known in advance; the letters go straight to the BPE model.  All other
    pieces go through the whole tokenizer.  Where each full stop and comma of a text
    stands alone between letters, digits and blanks it is a word of its own, so
    blanks may be put around it; there, and below U+0250, the text may also be
    lower-cased first.  Both make fewer different pieces."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept as 16 bits")
        self.model = self.tok.model
        self.words, self.marks, self.pieces = _Pieces(self._word), _Pieces(self._whole), _Pieces(self._piece)

    def _whole(self, piece: str) -> bytes:
        return array("H", self.tok.encode(piece, add_special_tokens=False).ids).tobytes()

    def _word(self, low: str) -> bytes:
        text = low if low.isascii() else "".join([_BYTE_CHARS[b] for b in low.encode()])
        return array("H", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        core = piece.strip(_MARKS)
        if not core.isalpha() or "<|" in piece:
            return self._whole(piece)
        low = core.lower()
        if not core.isascii() and (max(core) >= "\u0250" or len(low) != len(core) or not unicodedata.is_normalized("NFC", core)):
            return self._whole(piece)
        if low == piece:
            return self._word(low)
        if len(core) == len(piece):
            return self.words[low]
        at = piece.index(core)
        head, tail = piece[:at], piece[at + len(core):]
        return (self.marks[head] if head else b"") + self.words[low] + (self.marks[tail] if tail else b"")

    @staticmethod
    def _plain(text: str) -> bool:
        """Latin letters, and full stops and commas that touch no other mark."""
        if "<|" in text:                                    # may be a special token
            return False
        c = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not text.isascii() and c.max() >= len(_KIND):
            return False
        kind = _KIND[c]
        pair = kind[1:] * kind[:-1]
        return not ((pair == 1) | (pair == 2)).any()

    def _spread(self, text: str | None) -> str:
        """The text with every piece between blanks."""
        if text and self._plain(text):
            text = text.lower().replace(",", " , ").replace(".", " . ")
        return text.replace("\n", " ") if text else ""

    def sizes(self, texts: Sequence[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        ids, which, ends = self._split(texts)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        return np.diff(np.r_[0, np.cumsum(size[which])][ends])

    def _split(self, texts: Sequence[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of the different pieces, the piece at each place, bounds of the texts (in pieces)."""
        lists = pc.split_pattern(pa.array(map(self._spread, texts), pa.large_string()), pattern=" ")
        coded = lists.flatten().dictionary_encode()
        pieces = self.pieces
        return [pieces[p] for p in coded.dictionary.to_pylist()], coded.indices.to_numpy(), lists.offsets.to_numpy()

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text as 16-bit integers."""
        ids, which, ends = self._split(texts)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        flat, first = np.frombuffer(b"".join(ids), np.uint16), np.cumsum(size) - size
        n = size[which]
        stop = np.cumsum(n)
        out = flat[np.repeat(first[which] - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)]
        cut = np.r_[0, stop][ends]
        return [out[a:b] for a, b in zip(cut[:-1], cut[1:])]


def chunks(texts: Sequence[str | None], size: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` characters."""
    first = held = 0
    for k, t in enumerate(texts):
        held += len(t or "") + 1
        if held >= size:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, so that its memory outlives a task."""
    return WordTokenizer(path)


def tokens_of(docs: DataFrame, doc_id: str, text: str, source: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Written stage: ``doc_id, queue, part, before, n, ids``; ``before`` is the number of the
    queue's tokens ahead of the document in its part (task)."""
    src = docs.select(col(doc_id).cast("string").alias("doc_id"), col(source).cast("string").alias("queue"),
                      col(text).cast("string").alias("text"))        # ids as strings: pandas has no null integers
    schema = "doc_id string, queue string, part long, before long, n long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, sent = tokenizer(tokenizer_path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], np.uint16).tobytes()
        for batch in batches:
            for some in byte_slices(batch, 2, CHUNK_CHARS):
                ids = [x.tobytes() + end for x in tok.encode(some.column(2).to_pylist())]
                n, before = [len(x) // 2 for x in ids], []
                for q, k in zip(some.column(1).to_pylist(), n):
                    before.append(sent.get(q, 0))
                    sent[q] = before[-1] + k
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *(pa.array(x, pa.int64()) for x in ([part] * len(n), before, n)),
                                                  pa.array(ids, pa.binary())], ["doc_id", "queue", "part", "before", "n", "ids"])

    return stage(src.mapInArrow(giving_back(run), schema), "packing-tokens")


def mixture_plan(totals: list[int], weights: list[float] | None, size: int = SIZE) -> list[tuple[int, int, list[int], list[int]]]:
    """Segments ``(first window, windows, position of each queue, prefix weights or grants)``.

    ``windows`` > 0: that many full windows at the prefix weights (closed form);
    0: one window with explicit grants per queue.  A queue that takes part gets at
    least two tokens a window on average (else rounding could take tokens back), so
    at most ``size // 4`` queues take part at a time; others wait for their turn."""
    ask = [float(t) for t in totals] if weights is None else [float(w) for w in weights]
    if any(w < 0 for w in ask):
        raise ValueError("weights must not be negative")
    base = [max(1, round(SCALE * w / (sum(ask) or 1))) for w in ask]
    at, window, plan = [0] * len(totals), 0, []
    while any(t > x for t, x in zip(totals, at)):
        turn = [k for k, (t, x) in enumerate(zip(totals, at)) if t > x][:max(1, size // 4)]
        live = [base[k] if k in turn else 0 for k in range(len(totals))]
        while (least := -(-2 * sum(live) // size)) > min(live[k] for k in turn):
            live = [max(w, least) if w else 0 for w in live]
        prefix = np.cumsum(live).tolist()
        whole = min((t - x) * prefix[-1] // (w * size) for w, t, x in zip(live, totals, at) if w)
        if whole:
            plan.append((window, whole, list(at), prefix))
            at = [x + whole * size * c // prefix[-1] - whole * size * (c - w) // prefix[-1] for x, c, w in zip(at, prefix, live)]
            window += whole
        left = [t - x for t, x in zip(totals, at)]
        if not any(left):
            break
        grant, room = [0] * len(totals), min(size, sum(left))      # the window in which a queue runs dry
        while room:
            open_ = [k for k in range(len(totals)) if left[k] > grant[k] and (live[k] or not any(left[q] > grant[q] for q in turn))]
            total, give = sum(live[k] or base[k] for k in open_), room
            for k in open_:
                more = min(left[k] - grant[k], max(1, give * (live[k] or base[k]) // total), room)
                grant[k] += more
                room -= more
        plan.append((window, 0, list(at), grant))
        at, window = [x + g for x, g in zip(at, grant)], window + 1
    return plan


def _pieces(plan: list, queue: int, first: int, n: int, size: int) -> tuple[np.ndarray, ...]:
    """Window, offset and start of the pieces of queue positions ``first .. first + n - 1``."""
    js, offs, froms = [], [], []
    k = int(np.searchsorted([p[2][queue] for p in plan], first, "right")) - 1
    x, stop = first, first + n
    while x < stop:
        window, many, at, split = plan[k]
        top = plan[k + 1][2][queue] if k + 1 < len(plan) else stop
        k += 1
        if top <= x:
            continue
        upto = min(stop, top)
        if many:
            lo, hi, total = split[queue - 1] if queue else 0, split[queue], split[-1]
            sent = lambda j: j * size * hi // total - j * size * lo // total
            a, b, per = x - at[queue], upto - at[queue], (hi - lo) * size
            j = np.arange(max(0, a * total // per - 1), min(many, b * total // per + 2))      # within one token of the quota
            begin, end = sent(j), sent(j + 1)
            keep = (end > a) & (begin < b)
            j, begin = j[keep], begin[keep]
            cut = np.maximum(begin, a)
            js.append(window + j)
            offs.append((j + 1) * size * lo // total - j * size * lo // total + cut - begin)
            froms.append(at[queue] + cut)
        else:
            js.append(np.array([window]))
            offs.append(np.array([sum(split[:queue]) + x - at[queue]]))
            froms.append(np.array([x]))
        x = upto
    return np.concatenate(js), np.concatenate(offs), np.concatenate(froms) - first


def _runs(queue: np.ndarray, begin: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in runs that follow one another in a queue."""
    order = np.lexsort((begin, queue))
    q, x, e = queue[order], begin[order], (begin + n)[order]
    cut = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (x[1:] != e[:-1]), True])
    for a, b in zip(cut[:-1], cut[1:]):
        yield order[a:b]


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", source: str = "source",
         weights: dict[str | None, float] | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pieces: ``doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``weights`` gives sources their target proportions (missing ones: 0, served as
    the least weight); None: in proportion to their tokens."""
    tokens = tokens_of(docs, doc_id, text, source, tokenizer_path, end_id)
    parts = tokens.groupBy("queue", "part").agg(F.sum("n").alias("held"))
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stage(parts.withColumn("base", F.coalesce(F.sum("held").over(order), F.lit(0))), "packing-offsets")
    sums = sorted(((r.queue, r.held) for r in parts.groupBy("queue").agg(F.sum("held").alias("held")).collect()),
                  key=lambda r: (r[0] is not None, r[0] or ""))
    at = {q: k for k, (q, _) in enumerate(sums)}
    plan = mixture_plan([n for _, n in sums], weights and [weights.get(q, 0.0) for q, _ in sums], size)
    schema = ("doc_id string, source string, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long")
    pieces = pa.schema([(c, pa.string() if t == "string" else pa.int64()) for c, t in (f.split() for f in schema.split(", "))])

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        queue = rows["queue"].map(lambda q: at[q]).to_numpy()
        begin, n = (rows["base"] + rows["before"]).to_numpy(), rows["n"].to_numpy()
        pick, start, crc, seq, off, length = [], [], [], [], [], []
        for own in _runs(queue, begin, n):
            first, total = int(begin[own[0]]), int(n[own].sum())
            js, offs, froms = _pieces(plan, int(queue[own[0]]), first, total, size)
            heads = np.cumsum(n[own]) - n[own]
            edge = np.union1d(froms, heads)                         # window ends and document ends
            w, d = np.searchsorted(froms, edge, "right") - 1, np.searchsorted(heads, edge, "right") - 1
            wide = memoryview(np.frombuffer(b"".join(rows["ids"].iloc[own]), np.uint16).astype("<u4").tobytes())
            stops = np.r_[edge[1:], total]
            crc += [zlib.crc32(wide[a:b]) for a, b in zip((4 * edge).tolist(), (4 * stops).tolist())]
            pick.append(own[d])
            start.append(edge - heads[d])
            length.append(stops - edge)
            seq.append(js[w])
            off.append(offs[w] + edge - froms[w])
        pick = np.concatenate(pick)
        return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[pick], "source": rows["queue"].to_numpy()[pick], "start": np.concatenate(start),
                             "length": np.concatenate(length), "ids_crc32": crc, "doc_tokens": n[pick], "sequence_id": np.concatenate(seq),
                             "offset": np.concatenate(off)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in byte_slices(batch, batch.schema.get_field_index("ids"), IDS_BYTES):
                yield pa.RecordBatch.from_pandas(cut(some.to_pandas()), pieces, preserve_index=False)

    same = F.col("t.queue").eqNullSafe(F.col("p.queue")) & (F.col("t.part") == F.col("p.part"))
    rows = tokens.alias("t").join(parts.alias("p"), same).select("t.doc_id", "t.queue", "p.base", "t.before", "t.n", "t.ids")
    return rows.mapInArrow(giving_back(run), schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
