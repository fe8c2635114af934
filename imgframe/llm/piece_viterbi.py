"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one pass of Viterbi.

The automaton reads a text once; at each place it reports, over its output links, every piece that ends there,
longest first, and each relaxes the best score of that place. A character that no single-character piece covers
may also be taken as unknown, at the least score of all pieces minus ``UNKNOWN_PENALTY``, and is written as the
pieces of its UTF-8 bytes. Texts are cut first where no piece can cross, and each distinct cut is encoded
once for many texts.

The scores are those of the model file, read as log-probabilities whatever the model's own algorithm is; so a
file made for merging gives this method's best segmentation, and not the merges.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import forget, joined_ids, steps

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


class PieceModel:
    """Pieces and scores of a SentencePiece model file with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.bytes_ids) != 256:
            raise ValueError("a model with byte fallback is needed")
        normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.unknown = min(model.get_score(i) for i in normal) - UNKNOWN_PENALTY
        self.single = {self.pieces[i] for i in normal if len(self.pieces[i]) == 1}
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i, model.get_score(i)))
        self.automaton.make_automaton()
        texts = [self.pieces[i] for i in normal]
        if any(SPACE in t.lstrip(SPACE) for t in texts):
            raise ValueError("pieces that go on after a word's end are not supported")
        #: Control characters that no piece has.
        self.alone = [ord(c) for c in "\n\t\r" if not any(c in t for t in texts)]
        byte_of = {i: bytes([b]) for b, i in self.bytes_ids.items()}
        #: The bytes that each id stands for; control pieces stand for none.
        self.spelt = [byte_of[i] if i in byte_of else b"" if model.is_control(i) else self.pieces[i].replace(SPACE, " ").encode() for i in range(size)]
        self.known = self._anew()

    def _anew(self) -> dict[str, bytes]:
        """The ids of cuts, spaces as they stand in texts; at first that of a space mark that a text has itself."""
        return {SPACE: np.array([self.bytes_ids[b] for b in SPACE.encode()], np.int32).tobytes()}

    def viterbi(self, text: str) -> list[int]:
        """The piece ids of the best segmentation; of equal ones that whose last piece is longest."""
        n, lost = len(text), float("-inf")
        best, back, piece = [0.0] + [lost] * n, [0] * (n + 1), [0] * (n + 1)
        covered = self.single.issuperset(text)  # then no place needs the unknown character
        done = 0  # places up to here have been offered it

        def unknowns(upto: int) -> None:
            for i in range(done, upto):
                if text[i] not in self.single and best[i] + self.unknown > best[i + 1]:
                    best[i + 1], back[i + 1], piece[i + 1] = best[i] + self.unknown, i, -1

        for end, (length, i, score) in self.automaton.iter(text):
            if end > done and not covered:
                unknowns(end)
                done = end
            start = end + 1 - length
            score += best[start]
            if score > best[end + 1]:
                best[end + 1], back[end + 1], piece[end + 1] = score, start, i
        if not covered:
            unknowns(n)
        ids: list[int] = []
        while n:
            ids += [piece[n]] if piece[n] >= 0 else [self.bytes_ids[b] for b in reversed(text[back[n] : n].encode("utf-8", "surrogatepass"))]
            n = back[n]
        return ids[::-1]

    def _cuts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(cuts of all texts, first cut of each text with the end): what pieces never cross.

        A cut is a run of spaces with the word after it, a control character that no piece has, or a text's own mark.
        """
        _, bounds, data = texts.buffers()
        ends = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        text = np.frombuffer(data or b"", np.uint8)[: ends[-1]]
        begins = np.zeros(len(text) + 1, bool)
        begins[ends] = True
        blank, alone = text == ord(" "), np.isin(text, self.alone)
        begins[1:-1] |= blank[1:] & ~blank[:-1]
        begins[:-1] |= alone
        begins[1:] |= alone
        first, second, third = SPACE.encode()
        marks = np.flatnonzero(text == first)
        marks = marks[(text[marks + 1] == second) & (text[marks + 2] == third)]
        begins[marks] = begins[marks + 3] = True
        begins[: ends[0]] = False
        at = np.flatnonzero(begins)
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data), np.searchsorted(at, ends)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(int32 ids of all texts, where each text's ids begin and the end). A null or empty text has none.

        A space becomes the space mark and one more mark goes before the text. A mark that the text has itself is
        written as bytes, so decoding gives every text back.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        before = pc.if_else(pc.equal(texts, ""), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        cuts, ends = self._cuts(pc.binary_join_element_wise(before, texts, pa.scalar("", pa.large_string())))
        coded = cuts.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in words if w not in self.known]
        for w in new:
            self.known[w] = array("i", self.viterbi(w.replace(" ", SPACE))).tobytes()
        ids = [self.known[w] for w in words]
        flat, place = joined_ids(ids, coded.indices.to_numpy(zero_copy_only=False), np.int32)
        forget(self.known, new)
        self.known = self.known or self._anew()
        return flat, place[ends]

    def encode(self, text: str | None) -> np.ndarray:
        """int32 ids of a whole text, as ``encode_all`` gives them."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids of ``encode``; control pieces give nothing."""
        return b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


@functools.cache
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, model: str, column: str = "text", verify: bool = False) -> DataFrame:
    """``docs`` with ids array<int> and n_pieces long of the whole text in ``column``.

    verify: also exact boolean, whether decoding the ids gives the text back, worked out in the same task.

    Defined cases: a null or empty text has no pieces (ids is an empty array); existing ids, n_pieces and, to
    verify, exact columns are replaced; all other columns and repeated rows are passed on; no rows in, no rows out.
    """
    docs = docs.drop("ids", "n_pieces", *["exact"] * verify)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = piece_model(model)
        for batch in steps(batches, column):
            flat, place = held.encode_all(batch.column(column))
            new = {"ids": pa.ListArray.from_arrays(pa.array(place, pa.int32()), pa.array(flat)), "n_pieces": pa.array(np.diff(place))}
            if verify:
                texts = batch.column(column).to_numpy(zero_copy_only=False).tolist()
                new["exact"] = pa.array([held.decode(flat[a:b].tolist()) == (text or "") for a, b, text in zip(place[:-1].tolist(), place[1:].tolist(), texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, *new.values()], [*batch.schema.names, *new])

    return docs.mapInArrow(run, f"{schema}, ids array<int>, n_pieces long" + ", exact boolean" * verify)


def decode_pieces(encoded: DataFrame, model: str, to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in column ``to`` (replaced if there); null ids give a null text."""
    encoded = encoded.drop(to)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = piece_model(model).decode
        for batch in batches:
            lists = batch.column("ids")
            ids, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [decode(ids[a:b].tolist()) if there else None for a, b, there in zip(ends[:-1].tolist(), ends[1:].tolist(), lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, to])

    return encoded.mapInArrow(run, f"{schema}, `{to}` string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pieces, ids, exact): encoded, and whether decoding gave the text back."""
    return encode_pieces(docs.select("doc_id", "text"), model, verify=True).select("doc_id", "n_pieces", "ids", "exact")
