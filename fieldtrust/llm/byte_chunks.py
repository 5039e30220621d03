"""Byte-level BPE of whole texts through a table of known chunks, equal to the library's encoding.

A chunk is a blank and what follows up to the next blank that a visible character follows. No merge crosses such a blank,
so chunks are encoded apart. Chunks not met before are encoded by the library as one text; as every id stands for bytes,
the chunks' lengths in bytes tell where their ids end. Ids are kept in the width in which files store them.

Where the library cuts words as GPT-2 does, a new chunk made of words and punctuation only is put together from its parts,
so that "word," and "word.\\nNext" cost no encoding once "word", "," and so on are known.
"""

from __future__ import annotations

import os
import re
from collections.abc import Collection
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longest chunk that is kept, in characters, and most chunks in each of the table's two generations.
CHUNK, TABLE = 64, 300_000
#: The same where a worker's memory holds no other table.
WORKER_TABLE = 600_000


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: visible Latin ones for themselves, the others counted up from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteEncoder:
    """Encodes texts with a byte-level BPE file that neither normalises nor puts a blank before texts.

    With ``plain_controls`` the strings of control tokens inside texts are ordinary text.
    """

    _CUT = re.compile(r"(?= [!-~À-ɏ])")
    _WORD = re.compile(r" [!-~À-ɏ]")
    _NO_WORD = re.compile(r"\0 (?![!-~À-ɏ])")
    # A word after a blank or a line break, and punctuation behind a word; contractions are left to the library.
    _PART = r"[ \n][A-Za-zÀ-ÖØ-öø-ɏ]+|(?<=[A-Za-zÀ-ÖØ-öø-ɏ])[!-&(-/:-@\[-`{-~]+"
    _PARTS, _IN_PARTS = re.compile(_PART), re.compile(f"(?:{_PART})+")
    # What never occurs in such chunks.
    _NO_PARTS = re.compile(r"[!-&(-/:-@\[-`{-~][A-Za-zÀ-ÖØ-öø-ɏ]")

    def __init__(self, path: str, plain_controls: bool = False, table: int | None = None):
        self.table = table or TABLE
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain_controls
        bytes_, added = byte_of_character(), self.tokenizer.get_added_tokens_decoder()
        entries = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        try:
            #: The bytes of each id.
            self.bytes = [added[i].content.encode() if i in added else bytes(bytes_[c] for c in e) for i, e in enumerate(entries)]
        except KeyError as exc:
            raise ValueError("not a byte-level vocabulary") from exc
        self.lengths = np.array([len(b) for b in self.bytes], "i8")
        #: How files store an id.
        self.kind = "<u2" if len(self.bytes) <= 1 << 16 else "<u4"
        probe = self.tokenizer.encode("a A", add_special_tokens=False).ids
        if b"".join(self.bytes[i] for i in probe) != b"a A" or any(self._WORD.search(t.content) for t in added.values()):
            raise ValueError("not a plain byte-level vocabulary")
        cutting = self.tokenizer.pre_tokenizer
        #: Whether parts of a chunk are encoded apart: words are cut as in GPT-2 and no control token fits into such a chunk.
        self.in_parts = (
            isinstance(cutting, pre_tokenizers.ByteLevel) and cutting.use_regex and not cutting.add_prefix_space
            and self.tokenizer.normalizer is None and all(self._NO_PARTS.search(t.content) for t in added.values())
        )
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Each text's ids as little-endian integers of ``kind``; a chunk is looked up once, what is new in any text is encoded at once."""
        if not len(texts):
            return []
        self._turn()
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        cut = pc.split_pattern(pc.replace_substring(column, " ", "\0 "), "\0")
        numbered = cut.flatten().dictionary_encode()
        chunks = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self._young.get, chunks))
        whole = pc.match_substring(column, "\0").to_numpy(zero_copy_only=False)
        if None in found:
            missing = [c for c, ids in zip(chunks, found) if ids is None]
            # Only the first chunk may begin without a blank; other blanks are no places to cut.
            words = [c for c in missing if c[:1] == " "]
            firsts = [c for c in missing if c[:1] != " "] if len(words) < len(missing) else []
            if self._NO_WORD.search("\0".join(["", *words, ""])):
                words = list(filter(self._WORD.match, words))
            new = self._learn(words, firsts)
            found = [new.get(c) if ids is None else ids for c, ids in zip(chunks, found)]
        starts = cut.offsets.to_numpy()
        spread = pa.array(found, pa.large_binary()).take(numbered.indices)
        if spread.null_count:
            wrong = np.flatnonzero(spread.is_null().to_numpy(zero_copy_only=False))
            whole[np.searchsorted(starts, wrong, side="right") - 1] = True
        _, ends, raw = spread.buffers()
        ends = np.frombuffer(ends, "<i8")[starts].tolist()
        raw = raw.to_pybytes() if raw else b""
        out = [raw[a:b] for a, b in zip(ends, ends[1:])]
        at = np.flatnonzero(whole).tolist()
        for i, (_, parts) in zip(at, self.chunks([column[i].as_py() for i in at])):
            out[i] = b"".join(parts)
        return out

    def _turn(self) -> None:
        if len(self._young) > self.table:
            self._old, self._young = self._young, {}

    def chunks(self, texts: list[str]) -> list[tuple[list[str], list[bytes]]]:
        """The chunks of each text and the ids of each chunk."""
        self._turn()
        known, out = self._young.get, []
        words: dict[str, None] = {}
        firsts: dict[str, None] = {}
        for text in texts:
            chunks = [text] if "\0" in text else text.replace(" ", "\0 ").split("\0")
            found = list(map(known, chunks))
            if None in found:
                missing = [c for c, ids in zip(chunks, found) if ids is None]
                first = found[0] is None
                # Only the first chunk may begin without a blank; other blanks are no places to cut.
                if not all(map(self._WORD.match, missing[first:])):
                    chunks = self._CUT.split(text)
                    found = list(map(known, chunks))
                    missing = [c for c, ids in zip(chunks, found) if ids is None]
                    first = found[0] is None
                if first:
                    (words if self._WORD.match(missing[0]) else firsts)[missing[0]] = None
                    del missing[0]
                words.update(dict.fromkeys(missing))
            out.append((chunks, found))
        if words or firsts:
            new = self._learn(words, firsts)
            for chunks, found in out:
                if None in found:
                    found[:] = [new[c] if ids is None else ids for c, ids in zip(chunks, found)]
        return out

    def _learn(self, words: Collection[str], firsts: Collection[str]) -> dict[str, bytes]:
        """Ids of chunks that the young generation lacks, from the old one or encoded; all but very long ones are kept."""
        held = list(map(self._old.get, words))
        new = {c: ids for c, ids in zip(words, held) if ids is not None}
        unknown = [c for c, ids in zip(words, held) if ids is None]
        made, unknown = self._parted(unknown, new) if self.in_parts else ({}, unknown)
        new.update(zip(unknown, self._words(unknown)))
        self._alone(firsts, new)
        for chunk, parts in made.items():
            new[chunk] = b"".join(map(new.__getitem__, parts))
        self._young.update(new)
        if max(map(len, new), default=0) > CHUNK:
            for chunk in [c for c in new if len(c) > CHUNK]:
                del self._young[chunk]
        for chunk in firsts:
            if chunk[:1] == " " and not self._WORD.match(chunk):  # no chunk elsewhere
                self._young.pop(chunk, None)
        return new

    def _parted(self, chunks: list[str], new: dict[str, bytes]) -> tuple[dict[str, list[str]], list[str]]:
        """Those chunks that consist of several parts with their parts, and what is to be encoded for all of them.

        Parts already known, and punctuation, are put into ``new``.
        """
        made = {c: self._PARTS.findall(c) for c in chunks if not c[1:].isalpha() and self._IN_PARTS.fullmatch(c)}
        whole = dict.fromkeys([c for c in chunks if c not in made] if made else chunks)
        lines, signs = [], []
        for part in {p: None for parts in made.values() for p in parts}:
            if part in whole or part in new:
                continue
            ids = self._young.get(part) or self._old.get(part)
            if ids is not None:
                new[part] = ids
            elif part[0] == " ":
                whole[part] = None
            else:
                (lines if part[0] == "\n" else signs).append(part)
        self._alone(signs, new)
        # A line's word comes behind a letter, so that its break stays apart.
        return made, lines + list(whole)

    def _alone(self, chunks: Collection[str], new: dict[str, bytes]) -> None:
        """Puts the ids of each of the chunks, encoded as a text of its own, into ``new``."""
        for chunk, encoding in zip(chunks, self.tokenizer.encode_batch_fast(list(chunks), add_special_tokens=False)):
            new[chunk] = np.array(encoding.ids, self.kind).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of chunks that each begin a new word, which the library gets as one text."""
        if not words:
            return []
        text = "".join(words)
        sizes = list(map(len, words)) if text.isascii() else [len(w.encode()) for w in words]
        listed = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        if b"".join(map(self.bytes.__getitem__, listed)) != text.encode():
            raise ValueError("the vocabulary does not give a text's bytes back")
        ids = np.array(listed, self.kind)
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes), side="right") * ids.itemsize
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def worker_bytes(path: str) -> ByteEncoder:
    """The encoder of this Python worker, whose table of chunks the tasks that it runs fill together."""
    return ByteEncoder(path, table=WORKER_TABLE)
