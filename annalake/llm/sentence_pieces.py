"""SentencePiece encoding and decoding of BPE models by a streaming Viterbi search.

Each boundary of a text has one best path to it: the last piece is the one that
may follow the path it extends. For merges by rank that is a question about two
neighbours, whether merging their joint characters gives back these two pieces,
so one backpointer a boundary is all that the search keeps. No piece is longer
than the longest of the vocabulary, so only so many boundaries can still be
extended; as soon as the paths from all of them go through one boundary,
everything before it is final: its ids are committed and forgotten.

Where two characters stand side by side that no piece of the model has side by
side, no piece reaches across, so all paths meet there: before a run of blanks,
say. Texts are cut at these places, a task encodes each different part once, and
keeps the ids.

Results equal the library's for the same model. Defined results: a NULL text
counts as empty and has no ids. Texts are taken whole, whatever their length;
rows that repeat are encoded alike. As in the library, U+2581 is decoded as a
blank, and characters beyond the vocabulary are encoded byte by byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from annalake.llm.common import arrow_batch, text_slices, texts_of
from annalake.llm.pieces import PieceCache
from annalake.llm.shingles import text_bytes

BLANK = "▁"


class PieceModel:
    """Pieces of a model file, their ranks, and which two may stand side by side."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.rank = {self.pieces[i]: -model.get_score(i) for i in plain}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids))
        if set(self.bytes) != set(range(256)):
            raise ValueError("the model has no pieces for bytes")
        #: Bytes that follow each other in some piece, blanks marked or not.
        self.adjacent = np.zeros((256, 256), bool)
        for piece in self.ids:
            for form in (piece.replace(BLANK, " ").encode(), piece.encode()):
                self.adjacent[list(form[:-1]), list(form[1:])] = True
        mark = BLANK.encode()
        self.adjacent[[32, mark[-1]], [mark[0], 32]] = True
        #: What decoding a piece gives.
        self.decoded = [bytes([int(self.pieces[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else self.pieces[i].replace(BLANK, " ").encode() for i in range(size)]
        self._runs: dict[str, list[tuple[float, str, str]] | None] = {}
        self._beside: dict[tuple[str, str], bool] = {}

    def _run(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece of its characters: rank, and the piece at
        either end afterwards. None if they don't end in this piece."""
        if piece not in self._runs:
            parts, run = list(piece), []
            while len(parts) > 1:
                best, at = min((self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best == np.inf:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                run.append((best, parts[0], parts[-1]))
            self._runs[piece] = run if len(parts) == 1 else None
        return self._runs[piece]

    def stands(self, piece: str) -> bool:
        return self._run(piece) is not None

    def beside(self, left: str, right: str) -> bool:
        """Whether merging the characters of both leaves these two pieces."""
        known = self._beside.get((left, right))
        if known is None:
            if len(self._beside) > 1 << 20:
                self._beside.clear()
            known = self._beside[left, right] = self._meet(left, right)
        return known

    def _meet(self, left: str, right: str) -> bool:
        a, b = self._run(left), self._run(right)
        if a is None or b is None:
            return False
        i = j = 0
        end, begin = left[-1], right[0]
        while True:
            across = self.rank.get(end + begin, np.inf)
            on_left = a[i][0] if i < len(a) else np.inf
            on_right = b[j][0] if j < len(b) else np.inf
            if across < np.inf and across < on_left and across <= on_right:
                return False
            if on_left == on_right == np.inf:
                return True
            if on_left <= on_right:
                end = a[i][2]
                i += 1
            else:
                begin = b[j][1]
                j += 1

    def as_ids(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.bytes[x] for x in piece.encode("utf-8", "surrogatepass")]


def extend(model: PieceModel, text: str, last: list[str]) -> None:
    """Append the last piece of the path to each further boundary of ``text``."""
    ids, known, longest = model.ids, model._beside, model.longest
    for end in range(len(last), len(text) + 1):
        for start in range(max(0, end - longest), end):
            piece = text[start:end]
            if piece not in ids and start < end - 1:
                continue
            left = last[start]
            if left:
                fits = known.get((left, piece))
                if fits is None:
                    fits = model.beside(left, piece)
            else:
                fits = model.stands(piece)
            if fits:
                last.append(piece)
                break


class Search:
    """Takes characters as they come and gives ids as soon as they are final."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.text = ""  # the characters that are not committed
        self.last = [""]  # the last piece of the path to each boundary; at 0 the last committed piece

    def feed(self, characters: str) -> Iterator[list[int]]:
        window = 4 * self.model.longest
        for i in range(0, len(characters), window):
            self.text += characters[i : i + window]
            extend(self.model, self.text, self.last)
            if len(self.text) >= window:
                yield from self._commit()

    def _commit(self) -> Iterator[list[int]]:
        """Where the paths from all boundaries that can still be extended meet, all before is final."""
        end = len(self.text)
        alive = set(range(end - self.model.longest + 1, end + 1))
        while len(alive) > 1:
            latest = max(alive)
            alive.remove(latest)
            alive.add(latest - len(self.last[latest]))
        meeting = alive.pop()
        if meeting > 0:
            yield self._path(meeting)
            self.text, self.last = self.text[meeting:], self.last[meeting:]

    def _path(self, end: int) -> list[int]:
        pieces = []
        while end > 0:
            pieces.append(self.last[end])
            end -= len(self.last[end])
        return [i for piece in reversed(pieces) for i in self.model.as_ids(piece)]

    def finish(self) -> list[int]:
        return self._path(len(self.text))


def search(model: PieceModel, text: str) -> list[int]:
    """Ids of a text in which blanks are already marked."""
    one, out = Search(model), []
    for ids in one.feed(text):
        out += ids
    return out + one.finish()


class SentenceEncoder(PieceCache):
    def __init__(self, path: str) -> None:
        self.model = PieceModel(path)
        super().__init__(np.uint16 if len(self.model.pieces) <= 1 << 16 else np.uint32)
        self.decoded = np.frombuffer(b"".join(self.model.decoded), np.uint8)
        self.decoded_length = np.fromiter(map(len, self.model.decoded), np.int64, len(self.model.decoded))
        self.decoded_first = np.cumsum(self.decoded_length) - self.decoded_length

    def begins(self, data: np.ndarray, final: np.ndarray) -> np.ndarray:
        """Parts begin where a character starts that no piece has after the one before."""
        found = np.zeros(len(data), bool)
        found[1:] = ~self.model.adjacent[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        return found

    def ids_of(self, parts: list[str], at_start: list[bool]) -> list[list[int]]:
        """A text's first part has one blank more."""
        return [search(self.model, (BLANK if first else "") + part.replace(" ", BLANK)) for part, first in zip(parts, at_start, strict=True)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts in order, and the bounds of each text's; without the blank that encoding put first."""
        length = self.decoded_length[ids]
        starts = np.flatnonzero(np.diff(bounds) > 0)
        first = self.decoded_first[ids].copy()
        opening = bounds[starts]
        blank = self.decoded[first[opening]] == 32
        first[opening] += blank
        length[opening] -= blank
        total = np.concatenate([[0], np.cumsum(length)])
        return self.decoded[np.repeat(first - total[:-1], length) + np.arange(total[-1])], total[bounds]


_ENCODERS: dict[str, SentenceEncoder] = {}


def encoder(path: str) -> SentenceEncoder:
    """One for each Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SentenceEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of each row's whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            ids, bounds = encoder(model).encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows in order and each row's bounds; a NULL row has none."""
    lengths = np.array(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64)
    return np.array(column.flatten(), np.int64), np.concatenate([[0], np.cumsum(lengths)])


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = _lists(batch.column("ids"))
            data, edges = encoder(model).decode(ids, bounds)
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield arrow_batch({"doc_id": batch.column("doc_id"), "text": texts}, {"doc_id": pa.int64(), "text": pa.string()})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, ids, n_ids, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers), n_bytes of the decoded text, same (it is the text that was encoded)."""
    types = {"doc_id": pa.int64(), "ids": pa.list_(pa.int32()), "n_ids": pa.int64(), "ids_crc32": pa.int64(), "n_bytes": pa.int64(), "same": pa.bool_()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            own = encoder(model)
            ids, bounds = own.encode(batch.column("text"))
            data, edges = own.decode(ids, bounds)
            given, offsets = text_bytes(batch.column("text"))
            wide = ids.astype("<u4")
            crc = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            same = [np.array_equal(data[a:b], given[c:d]) for a, b, c, d in zip(edges[:-1], edges[1:], offsets[:-1], offsets[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(wide.astype(np.int32)))
            yield arrow_batch({"doc_id": batch.column("doc_id"), "ids": lists, "n_ids": np.diff(bounds), "ids_crc32": crc, "n_bytes": np.diff(edges), "same": same}, types)

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, n_ids long, ids_crc32 long, n_bytes long, same boolean")
