"""Token counts by the whole-token shortcut.

A byte-level BPE first cuts a text into pre-tokens and then merges inside each one. Most
pre-tokens are vocabulary strings. Offline, once per vocabulary, `whole_tokens` runs the merges
on every vocabulary string and keeps those that come out as one token (a string may be in the
vocabulary and still never be reached by the merges). A pre-token among them counts as one without
any merging; the merges run only for the rest, and a worker remembers what it has merged.

Equality with the library is kept by falling back to it, whole text at a time, where the two
regular-expression engines could disagree on a character class or where special strings occur.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storelens.llm.common import Learned, map_batches

# The split pattern of byte-level BPE, with white space spelled as the Unicode
# property, because engines differ on what else \s contains.
_SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# Outside these long-settled blocks the library cuts the text itself.
_UNSETTLED = r"[^\x00-ɏ‐-‧‰-›€]"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, by its rule:
    printable bytes stand for themselves, the others follow from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def check_supported(spec: dict) -> None:
    """Raises ValueError unless the shortcut is exact for this tokenizer."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type", "BPE") == "BPE"
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space")
        and not spec.get("normalizer")
        and not any(model.get(k) for k in ("dropout", "unk_token", "ignore_merges",
                                           "continuing_subword_prefix", "end_of_word_suffix"))
    )
    if not plain:
        raise ValueError("the whole-token shortcut needs a plain byte-level BPE")


def whole_tokens(tokenizer: Tokenizer) -> list[str]:
    """The vocabulary strings, as text, that the merges turn into exactly one token."""
    letters = _byte_letters()
    proven = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if all(c in letters for c in token) and len(tokenizer.model.tokenize(token)) == 1:
            raw = bytes(letters[c] for c in token)
            try:
                proven.append(raw.decode())
            except UnicodeDecodeError:  # part of a character: never a whole pre-token
                continue
    return proven


class Counter:
    """Counts the tokens of texts; made once in each worker."""

    def __init__(self, spec: str, proven: list[str]):
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.pieces = regex.compile(_SPLIT).findall
        self.unsettled = regex.compile(_UNSETTLED).search
        self.special = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
        letter = {b: c for c, b in _byte_letters().items()}
        merge = self.library.model.tokenize
        self.known = Learned(
            lambda piece: len(merge("".join(letter[b] for b in piece.encode()))),
            dict.fromkeys(proven, 1),
        )

    def __call__(self, text: str) -> int:
        if self.unsettled(text) or any(s in text for s in self.special):
            return len(self.library.encode(text, add_special_tokens=False))
        return sum(map(self.known.__getitem__, self.pieces(text)))


def count_tokens(
    docs: DataFrame,
    tokenizer_file: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs.

    A narrow map: no shuffle, one row out for each row in, repeated rows and null ids included.
    A null text counts as empty (0 bytes, 0 tokens). Other columns of docs are ignored, whatever
    their names. An empty table gives an empty result. The vocabulary file is read by the driver
    and sent along (a few MB, whatever the data).
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        spec = file.read()
    check_supported(json.loads(spec))
    proven = whole_tokens(Tokenizer.from_str(spec))
    made: list[Counter] = []

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Counter(spec, proven))
        column = batch.column(1)
        counts = [made[0](t) if t else 0 for t in column.to_pylist()]
        sizes = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), sizes, pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"]
        )

    kind = docs.schema[id_col].dataType.simpleString()
    counted = map_batches(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
        count, f"id {kind}, n_bytes long, n_tokens long",
    )
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
