"""SentencePiece encoding by a table of last tokens, and decoding by an offset table.

Merges go by the score of what they give: any two neighbours whose joined text is a piece may merge, the best score first, of
equal ones the leftmost. The encoder applies none of them one by one. Every prefix of a word has one last token in its encoding,
and the table holds it: of the pieces that end at a place (all matches of an Aho-Corasick automaton), it is the one that begins the word
or is *compatible* with the last token of the prefix before it. Two tokens are compatible when merging their joined text would leave
exactly these two. The ids are then read off backwards from the end of the table. A place has as many matches as the longest piece has
characters at most, so the work is linear in the length.

A text is cut into words only where no piece of the model can reach across: before a space mark that follows another character, before signs
and digits that follow a letter, and around control characters that are in no piece; all of this is read off the pieces. So words may be remembered.

Edge cases: a null or empty text gives the begin and end ids only and decodes to the empty text. Characters that are in no piece go as bytes.
Text that spells a control piece is ordinary text. Columns of the input beyond the id and the text are ignored, so names cannot clash; rows
with repeated or null ids are encoded one by one. An empty table gives an empty one. Models that are not of the merge type, that normalise
text, or that have no byte pieces are refused with a ValueError.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.bpe import CACHED_WORD_CHARS, CACHED_WORDS, OffsetTable
from granary.llm.common import ship_package

#: The model file that the contract names.
MODEL = "piece_bpe_32k.model"
#: The mark that stands for a space, and the numbers of piece and model types in model files.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2

_NEVER = 1 << 60
_FITS = 300_000  # remembered pairs


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class PieceCodec:
    """Encoder and decoder for one model file of the merge type."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as format_of

        spec = format_of.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        normal, trained = spec.normalizer_spec, spec.trainer_spec
        kinds = [p.type for p in spec.pieces]
        if trained.model_type != MERGE_TYPE or BYTE not in kinds or USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("the model must be of the merge type, with byte pieces and without user-defined or unused ones")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("the model must leave the text as it is, but for the space mark")
        self.prefix = SPACE if normal.add_dummy_prefix else ""
        self.begin, self.end = trained.bos_id, trained.eos_id
        self._ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.alphabet = frozenset("".join(self._ids))
        if any(c not in self._ids for c in self.alphabet):
            raise ValueError("every character of a piece must be a piece")
        self.dtype = np.dtype("<u2" if len(kinds) <= 1 << 16 else "<u4")
        self._coded = [i.tobytes() for i in np.arange(len(kinds), dtype=self.dtype)]
        self._set_words()
        scores = sorted({p.score for p in spec.pieces if p.type == NORMAL}, reverse=True)
        rank = {score: k for k, score in enumerate(scores)}
        self._set_merges({i: rank[spec.pieces[i].score] for i in self._ids.values()})
        surface = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN: lambda p: trained.unk_surface.encode(), CONTROL: lambda p: b""}
        spelled = [surface[p.type](p.piece) for p in spec.pieces]
        self._bytes = OffsetTable(spelled)
        self._control = np.array([k == CONTROL for k in kinds])
        self._byte = np.array([k == BYTE for k in kinds])
        self._spaced = np.array([k == NORMAL and s.startswith(b" ") for k, s in zip(kinds, spelled, strict=True)])
        self._byte_id = {spelled[i][0]: i for i, k in enumerate(kinds) if k == BYTE}
        self._cache: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _set_words(self) -> None:
        """How to cut a text where no piece reaches across."""
        pairs = {pair for p in self._ids for pair in zip(p, p[1:], strict=False)}
        apart = {chr(c) for c in range(32)} - self.alphabet
        if any(b == SPACE != a for a, b in pairs):  # then nothing but these characters parts words
            signs, spaces = set(), ""
        else:
            signs, spaces = {c for c in self.alphabet if not c.isalpha() and SPACE != c < "\U00010000"}, SPACE
            while bad := {b for a, b in pairs if b in signs and a not in signs and a != SPACE}:
                signs -= bad
        part = lambda chars: "".join(map(re.escape, sorted(chars)))
        cut, other = part(apart), rf"[^{part(apart | signs | set(spaces))}]+" if apart or signs or spaces else "(?s:.)+"
        forms = [*([f"[{cut}]"] if cut else []), *([f"{SPACE}*[{part(signs)}]*{other}", f"{SPACE}*[{part(signs)}]+"] if signs else [f"{spaces}*{other}" if spaces else other]), *([f"{SPACE}+"] if spaces else [])]
        self._words = re.compile("|".join(forms)).findall

    def _set_merges(self, rank: dict[int, int]) -> None:
        """Of each piece: its length, the two pieces that it is merged from at last, and when; and the automaton of all that merging can give."""
        size = max(rank) + 1
        self._length, self._when = [0] * size, [-1] * size
        self._parts: list[tuple[int, int]] = [(-1, -1)] * size
        self._rank, self._text = rank, [""] * size
        for piece, i in self._ids.items():
            self._length[i], self._text[i] = len(piece), piece
        trie = ahocorasick.Automaton()
        for piece, i in sorted(self._ids.items(), key=lambda x: len(x[0])):
            if len(piece) > 1:
                parts = self._merged(piece)
                if parts is None:  # its own text merges to something else, so it never comes up
                    continue
                self._parts[i] = parts
                self._when[i] = max(rank[i], *(self._when[x] for x in parts))
            trie.add_word(piece, i)
        trie.make_automaton()
        self._trie = trie
        self._fits: dict[tuple[int, int], bool] = {}

    def _merged(self, piece: str) -> tuple[int, int] | None:
        """The two pieces that merging the text of a piece joins at last; nothing if it ends otherwise."""
        ids, rank, now = self._ids, self._rank, list(piece)
        while len(now) > 1:
            best = min(((rank[ids[a + b]], k) for k, (a, b) in enumerate(zip(now, now[1:], strict=False)) if a + b in ids), default=None)
            if best is None:
                return None
            k = best[1]
            if len(now) == 2:
                return ids[now[0]], ids[now[1]]
            now[k : k + 2] = [now[k] + now[k + 1]]
        return None

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined text of both tokens gives these two again.

        Takes back the merges on both sides of the border, latest first, and looks at each pair that met there: it would have merged if what it
        gives comes before the merge that next changed the left one, and not after the one that next changed the right one (the leftmost goes first).
        """
        key = left << 20 | right
        if left < 0:  # a character of no piece merges with nothing
            return True
        ids, text, when, parts, rank = self._ids, self._text, self._when, self._parts, self._rank
        left_until = right_until = _NEVER
        fits = True
        while True:
            across = ids.get(text[left] + text[right])
            if across is not None:
                at = max(rank[across], when[left], when[right])
                if at < left_until and at <= right_until:
                    fits = False
                    break
            if when[left] < 0 and when[right] < 0:
                break
            if when[left] > when[right]:
                left_until, left = when[left], parts[left][1]
            else:
                right_until, right = when[right], parts[right][0]
        if len(self._fits) > _FITS:
            self._fits.clear()
        self._fits[key] = fits
        return fits

    def last_tokens(self, word: str) -> list[int]:
        """The last token of each prefix of a word, by the prefix's length; -1 for the empty one, and for those that end in a character of no piece."""
        length, fits, compatible = self._length, self._fits, self.compatible
        last = [-1] * (len(word) + 1)
        for at, token in self._trie.iter(word):
            at += 1
            if last[at] >= 0:
                continue
            before = at - length[token]
            if before:
                left = last[before]
                known = fits.get(left << 20 | token)
                if known is None:
                    known = compatible(left, token)
                if not known:
                    continue
            last[at] = token
        return last

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word: known stretches by the table, other characters by their bytes."""
        last, at, backwards = self.last_tokens(word), len(word), []
        if last.count(-1) > 1:
            stretches = [(known, "".join(own)) for known, own in groupby(word, self.alphabet.__contains__)]
            return [i for known, x in stretches for i in (self.encode_word(x) if known else map(self._byte_id.__getitem__, x.encode()))]
        length = self._length
        while at:
            backwards.append(last[at])
            at -= length[last[at]]
        return backwards[::-1]

    def _miss(self, word: str) -> bytes:
        ids = self._older.get(word)
        if ids is None:
            ids = b"".join(map(self._coded.__getitem__, self.encode_word(word)))
        if len(word) <= CACHED_WORD_CHARS:
            if len(self._cache) >= CACHED_WORDS // 2:
                self._cache, self._older = {}, self._cache
            self._cache[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, with the begin and end ids."""
        found = [self._coded[self.begin]]
        if text:
            cache, miss = self._cache, self._miss
            found.extend([cache.get(word) or miss(word) for word in self._words(self.prefix + text.replace(" ", SPACE))])
        found.append(self._coded[self.end])
        return np.frombuffer(b"".join(found), self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids. Of the first token that shows, one leading space goes if the model adds one; bytes that are no UTF-8 give U+FFFD each."""
        ids = np.asarray(ids, np.int64)
        shown = np.flatnonzero(~self._control[ids])
        cut = int(bool(self.prefix) and len(shown) > 0 and bool(self._spaced[ids[shown[0]]]))
        try:
            if len(shown) and shown[-1] - shown[0] >= len(shown):  # bytes on both sides of a control token make no character
                raise UnicodeDecodeError("utf-8", b"", 0, 1, "control tokens within")
            return self._bytes.join(ids)[cut:].decode()
        except UnicodeDecodeError:
            is_byte = self._byte[ids]
            edges = [0, *(np.flatnonzero(np.diff(is_byte)) + 1).tolist(), len(ids)]
            runs = [(is_byte[a], self._bytes.join(ids[a:b])) for a, b in zip(edges, edges[1:], strict=False)]
            return "".join(_one_by_one(raw) if own else raw.decode() for own, raw in runs)[cut:]


def _one_by_one(raw: bytes) -> str:
    """Bytes as text, with a replacement character for each byte that belongs to no character."""
    text, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                text.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            text.append("�")
            at += 1
    return "".join(text)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One codec per worker process and file."""
    return PieceCodec(path)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: id, n_tokens, ids_sha256, decoded_sha256, and token_ids if asked for.

    The digest of ids is over little-endian unsigned 32-bit integers; ``token_ids`` holds them in two bytes each (four from 65,537 pieces on).
    Runs map-side: no shuffle, one Arrow batch at a time; ``model`` is a path that every executor has.
    """
    ship_package(docs.sparkSession)
    path = model or default_model()
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            counts, digests, decoded, raw = [], [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py())
                counts.append(len(ids))
                digests.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                if with_ids:
                    raw.append(ids.tobytes())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "token_ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * with_ids
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
