"""Whole texts to token ids with a public tokenizer file, each distinct word encoded once per batch.

The default tokenizer drops white space and never joins pieces across it, so a text's ids are
its words' ids in order. Words are cut at ASCII white space only; whatever else the tokenizer
treats as space stays inside a word and is left to it. A word of Latin letters, with or without
plain marks after it, is lower-cased and given to the merges directly; its normal form is itself.
Words are told apart, cut and laid end to end column by column; only distinct ones meet a loop.
Other tokenizer files get whole texts.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fieldmark.llm.common import text_bytes

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(path: str | None = None) -> str:
    """The given file, or the installed public one."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


#: how the default file normalises and splits; files that differ get whole texts
STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
LATIN, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", ".,!?;:|%$*#&"
BYTE_CHARS = {
    b: chr(b) if 33 <= b < 127 or 161 <= b < 173 or b >= 174 else chr(256 + b - (0 if b < 33 else 94 if b < 161 else 106))
    for b in range(256)
}
_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str | None = None, literal: bool = False) -> WordEncoder:
    """The worker process's encoder of a file; it keeps frequent words from task to task."""
    if (path, literal) not in _encoders:
        _encoders[path, literal] = WordEncoder(path, literal)
    return _encoders[path, literal]


def joined(table: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the entries ``codes`` of a table of ids in bytes, end to end; offsets of each in them)."""
    raw, offs = text_bytes(table.take(pa.array(codes)))
    return raw.view(np.int32), offs // 4


class WordEncoder:
    """Encodes Arrow columns of texts. ``literal`` reads special tokens' names as ordinary text.

    ``remembered`` bounds the words kept from batch to batch; it limits memory, not results.
    """

    def __init__(self, path: str | None = None, literal: bool = False, remembered: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(path))
        self.tokenizer.encode_special_tokens = literal
        self.model = self.tokenizer.model
        found = json.loads(self.tokenizer.to_str())
        steps = [[x["type"] for x in ((found[k] or {}).get(k + "s") or (found[k] or {}).get(k.replace("_", "") + "s") or [])] for k in ("normalizer", "pre_tokenizer")]
        self.by_word = (steps[0], steps[1]) == STEPS
        self.remembered, self.known, self.earlier = remembered, {}, {}

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of runs of lower-case Latin letters or of plain marks: each is one piece to the tokenizer."""
        if 2 * len(self.known) > self.remembered:  # what was met of late stays in reach
            self.known, self.earlier = {}, self.known
        known, earlier, tokenize, out = self.known, self.earlier, self.model.tokenize, []
        for text in texts:
            found = known.get(text)
            if found is None:
                found = earlier.get(text)
                if found is None:
                    chars = text if text.isascii() else "".join([BYTE_CHARS[b] for b in text.encode()])
                    found = array("i", [t.id for t in tokenize(chars)]).tobytes()
                known[text] = found
            out.append(found)
        return out

    def _others(self, words: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(words), 4096):
            found = self.tokenizer.encode_batch_fast(words[at : at + 4096], add_special_tokens=False)
            out += [array("i", x.ids).tobytes() for x in found]
        return out

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words, offsets of each word in them). Letters that differ in case or marks only are looked up once."""
        letters = pc.utf8_rtrim(words, characters=MARKS)
        plain = pc.match_substring_regex(letters, f"^{LATIN}$")
        cores = pc.utf8_lower(letters.filter(plain)).dictionary_encode()
        tails = pc.replace_substring_regex(words.filter(plain), f"^{LATIN}", "").dictionary_encode()
        pieces = self._pieces(cores.dictionary.to_pylist() + tails.dictionary.to_pylist())
        nothing = len(pieces)
        pieces += [b"", *self._others(words.filter(pc.invert(plain)).to_pylist())]
        latin = plain.to_numpy(zero_copy_only=False).astype(bool)
        codes = np.full((len(words), 2), nothing)
        codes[latin, 0] = cores.indices.to_numpy(zero_copy_only=False)
        codes[latin, 1] = len(cores.dictionary) + tails.indices.to_numpy(zero_copy_only=False)
        codes[~latin, 0] = np.arange(nothing + 1, len(pieces))
        ids, offs = joined(pa.array(pieces, pa.large_binary()), codes.ravel())
        return ids, offs[::2]

    def _whole(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        ids = [x + [end] if end is not None else x for x in found]
        return np.array([i for x in ids for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them); ``end`` is put after each text."""
        texts = column.cast(pa.large_string()).fill_null("")
        if not self.by_word:
            return self._whole(texts, end)
        words = pc.ascii_split_whitespace(texts)
        flat = words.flatten().dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False)
        offs = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
        ids, stops = self._ids(flat.dictionary)
        if end is not None:  # a word of its own after each text
            codes = np.insert(codes, offs[1:], len(flat.dictionary))
            offs = offs + np.arange(len(offs))
            ids, stops = np.append(ids, np.int32(end)), np.append(stops, len(ids) + 1)
        table = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops) - 1, [None, pa.py_buffer(4 * stops), pa.py_buffer(ids)])
        ids, stops = joined(table, codes)
        return ids, stops[offs]
