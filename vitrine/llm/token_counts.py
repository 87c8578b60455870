"""Token counts by batch encoding; only lengths leave the Arrow function."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import tokenizer_path

#: One encode call gets texts of about this many UTF-8 bytes; a longer text is split.
BATCH_BYTES = 1 << 18
#: A single space between two word characters. Pre-tokens hold a space only at their start, so the text may be cut before it.
_SAFE = re.compile(r"(?<=\w) (?=\w)")
#: White space that the faster library is not trusted with; it fails at about ten times as much.
LONG_RUN = 100_000
_LONG_RUN = re.compile(rf"\s{{{LONG_RUN}}}")


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], Sequence[int]]:
    """A function from a text to its token ids as the library for ``path`` gives them, without added special tokens.

    Strings of special tokens inside texts are special. For the byte-level vocabulary that lies beside the same one in the other
    library's format, that library gives the same ids several times faster, as arrays (the tests hold one against the other). It fails
    on very long runs that its pattern must go back over, so a text with such a run, or one that it fails on, goes to the named library.
    """
    if path.endswith(".model"):
        import sentencepiece

        return partial(sentencepiece.SentencePieceProcessor(model_file=path).encode, num_threads=1)
    twin = path.removesuffix(".json") + ".tiktoken"
    if path.endswith("byte_bpe_50k.json") and os.path.exists(twin):
        import base64

        import public_tokenizers
        import tiktoken

        with open(twin, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(path, encoding="utf-8") as lines:
            special = {a["content"]: a["id"] for a in json.load(lines)["added_tokens"]}
        made = tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> Sequence[int]:
            if len(text) < LONG_RUN or not _LONG_RUN.search(text):
                try:
                    return made.encode_to_numpy(text, allowed_special="all")
                except ValueError:  # out of stack
                    pass
            return named_library(path)(text)

        return encode
    return named_library(path)


@lru_cache(maxsize=4)
def named_library(path: str) -> Callable[[str], Sequence[int]]:
    """The encoder of the tokenizers library for ``path``."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core; Spark runs tasks side by side
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda text: np.asarray(library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=4)
def batch_counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from a batch of texts to their numbers of tokens, by one call of the library for ``path``, without added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        encode = partial(sentencepiece.SentencePieceProcessor(model_file=path).encode, num_threads=1)
        return lambda batch: list(map(len, encode(batch)))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core; Spark runs tasks side by side
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda batch: list(map(len, library.encode_batch_fast(batch, add_special_tokens=False)))


def safe_pieces(text: str, size: int = BATCH_BYTES) -> list[str]:
    """``text`` cut into pieces of about ``size`` UTF-8 bytes whose token counts add up to that of the whole.

    Cuts lie before a single space between word characters. A run without such a place stays whole.
    """
    if len(text) * 4 <= size or len(text.encode()) <= size:
        return [text]
    pieces, begin = [], 0
    while begin < len(text):
        # as many characters as the bytes allow: no character has fewer than one byte
        window = text[begin : begin + size].encode()
        if len(window) <= size and begin + size >= len(text):
            break
        reach = len(window[:size].decode(errors="ignore"))
        found = _SAFE.search(text, begin + reach)
        if not found:
            break
        pieces.append(text[begin : found.start()])
        begin = found.start()
    pieces.append(text[begin:])
    return pieces


def count_texts(texts: Iterable[str | None], path: str, size: int = BATCH_BYTES) -> list[int]:
    """Tokens of each text, encoded in batches of about ``size`` bytes whatever the lengths of the texts; no more than a batch is held."""
    count, counts = batch_counter(path), []
    splits = not path.endswith(".model")  # sentencepiece joins words across spaces, so its texts stay whole
    batch: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        for owner, n in zip(owners, count(batch) if batch else [], strict=True):
            counts[owner] += n
        batch.clear()
        owners.clear()

    for i, text in enumerate(texts):
        counts.append(0)
        for piece in safe_pieces(text or "", size) if splits else [text or ""]:
            weight = len(piece.encode())
            if held and held + weight > size:
                flush()
                held = 0
            batch.append(piece)
            owners.append(i)
            held += weight
    flush()
    return counts


def token_counts(docs: DataFrame, path: str | None = None, text: str = "text", limit: int = 1024) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to every row.

    A null text counts as empty: 0 bytes, 0 tokens. Columns of these names are replaced, others pass through untouched.
    Repeated rows are counted each on their own; an empty table gives an empty result.
    """
    path = path or tokenizer_path()

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(count_texts((t.as_py() for t in texts), path), pa.int64())

    whole = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": lengths(F.col(text))})
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
