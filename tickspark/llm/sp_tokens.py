"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed and its normaliser, word-start marker, unigram scores (or merges) and byte fallback are
rebuilt as a tokenizers pipeline.  Pieces never reach over the start of a marker run, so texts are cut there and
every distinct cut is encoded once, in multithreaded batches.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, whole_text, worker_object
from .sp_model import BPE, BYTE, MARK, NORMAL, UNIGRAM, SpModel, USER, read_model


def build_tokenizer(model: SpModel, threads: int = 2):
    """The tokenizers pipeline of a parsed model."""
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    if model.model_type == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    elif model.model_type == BPE:
        usable = {p for p, _, kind in model.pieces if kind in (NORMAL, USER)}
        ranked = sorted((i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL and len(p) > 1), key=lambda i: (-model.pieces[i][1], i))
        merges = [(p[:k], p[k:]) for p in (model.pieces[i][0] for i in ranked) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        core = models.BPE(vocab, merges, unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else [])])
    return tokenizer


class SpEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids (bytes) and decodes them."""

    def __init__(self, model: SpModel, threads: int = 2, max_cuts: int = 400_000):
        self.model, self.tokenizer, self.max_cuts = model, build_tokenizer(model, threads), max_cuts
        pieces = [p for p, _, kind in model.pieces if kind in (NORMAL, USER)]
        self.cuttable = model.escape_whitespaces and model.add_dummy_prefix and not any(MARK in p.lstrip(MARK) for p in pieces)
        lines = self.cuttable and model.byte_fallback and not any("\n" in p for p in pieces)
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if lines else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.memo: dict[str, bytes] = {}
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() if kind in (NORMAL, USER) else b" \xe2\x81\x87 " if i == model.unk_id else b"" for i, (p, _, kind) in enumerate(model.pieces)]
        from tokenizers import normalizers

        self.bare = build_tokenizer(model, threads)
        self.bare.normalizer = normalizers.Sequence([])

    def normalise(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if text else ""

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuttable:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.memo) > self.max_cuts:
            self.memo = {}
        simple = not self.model.charsmap and not self.model.remove_extra_whitespaces
        cuts = [self.cut(MARK + x.replace(" ", MARK) if simple and x else self.normalise(x)) for x in texts]
        missing = list(set().union(*cuts).difference(self.memo)) if cuts else []
        for at in range(0, len(missing), 8192):
            part = missing[at : at + 8192]
            for x, e in zip(part, self.bare.encode_batch_fast(part, add_special_tokens=False)):
                self.memo[x] = array("I", e.ids).tobytes()
        get = self.memo.__getitem__
        return [b"".join(map(get, c)) for c in cuts]

    def decode(self, ids: bytes) -> str:
        """The text of ids, as the library's decoder gives it."""
        text = b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")
        return text[1:] if self.model.add_dummy_prefix and text[:1] == " " else text


def worker_encoder(path: str, threads: int) -> SpEncoder:
    """The worker's encoder for a model file."""
    return worker_object(("pieces", path, threads), lambda: SpEncoder(read_model(path), threads))


def encode_documents(docs: DataFrame, model_path: str, threads: int = 2, check_every: int = 1, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip, parity[, ids array<int>]) of each row; null text counts as empty and has no token.

    Repeated rows and null ids stay; other columns are left out; an empty table gives an empty one; long texts are encoded whole.

    round_trip: the decoded ids are the normalised text.  parity: the text is encoded whole by the sentencepiece
    library too and compared; with a larger `check_every` only each such text of a task is (null for the others).
    """
    schema = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        encoder, k = worker_encoder(model_path, threads), 0
        library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = not encoder.model.charsmap and not encoder.model.remove_extra_whitespaces
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            n, crc, trip, same, kept = [], [], [], [], []
            for a, b in slices(texts):
                for text, ids in zip(texts[a:b], encoder.encode(texts[a:b])):
                    n.append(len(ids) // 4)
                    crc.append(zlib.crc32(ids))
                    want = text if plain else encoder.normalise(text).replace(MARK, " ").removeprefix(" ")
                    trip.append(encoder.decode(ids) == want.replace(MARK, " "))
                    same.append(np.frombuffer(ids, "<u4").tolist() == library.encode(text, num_threads=1) if k % check_every == 0 else None)
                    if keep_ids:
                        kept.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    k += 1
            out = [names, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(trip, pa.bool_()), pa.array(same, pa.bool_())]
            labels = ["doc_id", "n_tokens", "ids_crc32", "round_trip", "parity"]
            if keep_ids:
                out, labels = [*out, pa.array(kept, pa.list_(pa.int32()))], [*labels, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=labels)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    return source.mapInArrow(run, schema)
