"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is cut where no merge can cross (before a run of word marks, around line ends), and each segment
is merged by an agenda of adjacent symbol pairs: the pair of best score first, the leftmost of equals.
Segments repeat, so each Python worker keeps the ids of recent ones (two generations of bounded size).
Every segment that the agenda has encoded is compared with the sentencepiece library before its Arrow
batch is returned; where they differ the library's ids are used and the document's ``n_disagree`` says so.

Defined results: a null text is an empty one; an empty text has the begin and end ids only; repeated
rows are each encoded; an empty table gives no rows; columns other than the key and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.llm._common import map_arrow, table

MARK = "▁"
SEGMENTS, CHARACTERS = 600_000, 1 << 24  # kept by a worker in each of two generations: at most so many segments, or characters of them
SHORT = 40  # symbols up to which a flat agenda is faster than a heap


class _Recent(dict):
    """Segment -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old, self.characters = encode, most, {}, 0

    def __missing__(self, segment: str) -> bytes:
        ids = self.old.get(segment)
        if ids is None:
            ids = self.encode(segment)
        self[segment] = ids
        self.characters += len(segment)
        return ids

    def turn(self) -> None:
        """Between batches: a full generation becomes the old one."""
        if len(self) > self.most or self.characters > CHARACTERS:
            self.old = dict(self)
            self.clear()
            self.characters = 0


class Codec:
    """A merge-type model given as the bytes of its file."""

    def __init__(self, model: bytes, keep: int = SEGMENTS):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        kinds = {p.type for p in spec.pieces}
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2:
            raise ValueError("not a merge-type model")
        if kinds & {4, 5} or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without normalisation, user-defined and unused pieces, with a leading word mark, are supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unk, self.bos, self.eos = self.library.unk_id(), self.library.bos_id(), self.library.eos_id()
        self.byte_fallback = spec.trainer_spec.byte_fallback
        self.id = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        self.cost = {p.piece: -p.score for p in spec.pieces if p.type == 1}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        surface = spec.trainer_spec.unk_surface.encode()
        table: list[bytes] = []
        for p in spec.pieces:
            table.append({2: surface, 3: b"", 6: b""}.get(p.type, p.piece.replace(MARK, " ").encode()))
        for b, i in self.byte_id.items():
            table[i] = bytes([b])
        self.surface = table
        self.starts_with_mark = [p.type == 1 and p.piece.startswith(MARK) for p in spec.pieces]
        self.control = {i for i, p in enumerate(spec.pieces) if p.type == 3}
        many = [p for p in self.id if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in many):
            raise ValueError("a piece has a word mark behind other characters: texts cannot be cut at words")
        if any("\n" in p for p in many):
            raise ValueError("a piece joins a line end: texts cannot be cut at lines")
        self.line_end = self._ids(["\n"])
        self.joined = {p[i : i + 2] for p in many for i in range(len(p) - 1)}
        self.plain = _Recent(self._pieces, keep)
        self.marked = _Recent(lambda w: self._pieces(MARK + w), keep)
        self.fresh: list[tuple[str, bytes]] = []
        self.wrong: dict[str, bytes] = {}
        self.odd = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def _ids(self, symbols: list[str]) -> bytes:
        out: list[int] = []
        for s in symbols:
            i = self.id.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_fallback:
                out += [self.byte_id[b] for b in s.encode()]
            else:
                out.append(self.unk)
        return np.array(out, "<u4").tobytes()

    def _pieces(self, segment: str) -> bytes:
        """Two characters that no piece has side by side are never merged: there a segment is cut
        further, so that a word's forms with different punctuation share its ids."""
        cuts = [i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in self.joined]
        if not cuts:
            if segment in self.wrong:
                return self.wrong[segment]
            ids = self._ids(self.merge(segment))
            self.fresh.append((segment, ids))
            return ids
        return b"".join([self.plain[segment[a:b]] for a, b in zip([0, *cuts], [*cuts, len(segment)], strict=True)])

    def merge(self, segment: str) -> list[str]:
        return self._merge_flat(list(segment)) if len(segment) <= SHORT else self._merge_heap(list(segment))

    def _merge_flat(self, symbols: list[str]) -> list[str]:
        none = float("inf")
        cost = self.cost.get
        agenda = [cost(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            k = agenda.index(best)
            symbols[k] += symbols.pop(k + 1)
            del agenda[k]
            if k:
                agenda[k - 1] = cost(symbols[k - 1] + symbols[k], none)
            if k < len(agenda):
                agenda[k] = cost(symbols[k] + symbols[k + 1], none)
        return symbols

    def _merge_heap(self, symbols: list[str]) -> list[str]:
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        cost = self.cost.get
        agenda: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (c := cost(both := symbols[a] + symbols[b])) is not None:
                heapq.heappush(agenda, (c, a, b, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, both = heapq.heappop(agenda)
            if not symbols[a] or not symbols[b] or after[a] != b or symbols[a] + symbols[b] != both:
                continue
            symbols[a], symbols[b] = both, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbols if s]

    def encode(self, text: str) -> bytes:
        """The ids without begin and end."""
        if not text:
            return b""
        parts: list[bytes] = []
        marked, plain = self.marked, self.plain
        strange = MARK in text
        for k, line in enumerate(text.split("\n")):
            if k:
                parts.append(self.line_end)
            if strange or "  " in line or line.startswith(" "):
                parts += map(plain.__getitem__, self.odd.findall((MARK if k == 0 else "") + line.replace(" ", MARK)))
            else:
                words = line.split(" ")
                if k:
                    if words[0]:
                        parts.append(plain[words[0]])
                    del words[0]
                parts += map(marked.__getitem__, words)
        return b"".join(parts)

    def compare(self) -> bool:
        """Hold what the agenda has encoded anew against the library; put right what differs. True if all agree."""
        fresh, self.fresh = self.fresh, []
        right: dict[str, bytes] = {}
        for at in range(0, len(fresh), 50_000):
            part = fresh[at : at + 50_000]
            known = self.library.encode(["\n" + s for s, _ in part], num_threads=1)
            n = sum(map(len, known)) - 2 * len(known)
            if np.fromiter((i for x in known for i in x[2:]), "<u4", n).tobytes() != b"".join([ids for _, ids in part]):
                right |= {s: good for (s, ids), x in zip(part, known, strict=True) if ids != (good := np.array(x[2:], "<u4").tobytes())}
        if right:
            self.wrong |= right
            for recent in (self.marked, self.plain):  # what was put together from wrong ids goes
                recent.clear()
                recent.old = {}
        return not right

    def decode(self, ids: list[int]) -> str:
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        first = next((i for i in ids if i not in self.control), None)
        if first is not None and self.starts_with_mark[first]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _lenient(raw)


def _lenient(raw: bytes) -> str:
    """UTF-8 with each byte that is no part of a character replaced by one U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
        try:
            out.append(raw[i : i + n].decode())
            i += n
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


_codecs: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """This process's codec of a model."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def encode_texts(texts: list[str | None], c: Codec) -> tuple[list[bytes], list[int]]:
    """Ids with begin and end, and the number of segments on which the library differed."""
    texts = [t or "" for t in texts]
    out = [c.encode(t) for t in texts]
    if not c.compare():
        out = [c.encode(t) for t in texts]
    wrong = [sum((MARK + t.replace(" ", MARK)).count(s) for s in c.wrong) if c.wrong else 0 for t in texts]
    c.marked.turn()
    c.plain.turn()
    bos, eos = (np.array([i], "<u4").tobytes() for i in (c.bos, c.eos))
    return [bos + x + eos for x in out], wrong


def encode_decode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", ids: bool = True, decoded: bool = True, digests: bool = False) -> DataFrame:
    """``key, n_tokens, n_disagree`` and, as asked for, ``ids array<int>``, ``decoded string`` and the
    digests ``ids_sha256`` and ``decoded_sha256`` of those two. The model is a file that the driver
    reads; its bytes, under a megabyte or two, go to the tasks."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_tokens long, n_disagree long" + ", ids array<int>" * ids + ", decoded string" * decoded + ", ids_sha256 string, decoded_sha256 string" * digests
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                raw, wrong = encode_texts(batch.column(1).to_pylist(), c)
                arrays = [np.frombuffer(x, "<u4") for x in raw]
                cols = [batch.column(0), pa.array([len(a) for a in arrays], pa.int64()), pa.array(wrong, pa.int64())]
                if ids:
                    ends = np.cumsum([0, *(len(a) for a in arrays)])
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays).astype(np.int32))))
                if decoded or digests:
                    lists = [a.tolist() for a in arrays]
                    back = c.library.decode(lists)  # what the library says wins, and a difference is counted
                    cols[2] = pa.array([w + (c.decode(i) != b) for w, i, b in zip(wrong, lists, back, strict=True)], pa.int64())
                if decoded:
                    cols.append(pa.array(back, pa.string()))
                if digests:
                    cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in raw]))
                    cols.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]))
                yield pa.RecordBatch.from_arrays(cols, names)

    return map_arrow(docs.select(key, F.col(text).cast("string").alias("_text")), run, schema)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return encode_decode(table(spark, sf_dir, "documents"), model_path(), ids=False, decoded=False, digests=True)
