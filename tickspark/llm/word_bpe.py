"""BPE encoding and decoding with a contiguous rank array.

A word is held as its part ids side by side with the ranks of its adjacent pairs; the smallest rank
is looked for again and again, its boundary deleted (everything behind moves up one place) and the
two neighbouring ranks refreshed, until no pair has a rank. Words of one length are done together,
a row of a small array each. Texts are normalised and cut into words as the vocabulary file says;
finished words are remembered per task, so common words are encoded once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import gathered, text_batches

#: Fixed values of the vocabulary's own normaliser and word pattern: white space, and the letters and
#: numbers of Unicode 17 that the pattern, which knows Unicode 16, takes for other signs.
BLANK = r"\t-\r \x85\xa0  -     　"
NEWER = (r"՘֋֌࢏౜೜₏₝-₟꟎꟏꟒꟔꟝꟢꟱꭬꭭"
         r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
         r"\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
         r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
         r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
         r"\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
         r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
         r"\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
         r"\U0003d000-\U0003fc3f")
#: Combining marks that the normaliser's older tables take for letters that stand alone.
ALONE = (r"߽࢘-࢟࣊-఼഻഼຺᜕࣓ᪿ৾-ᫎ᷶-᷺"
         r"꠬\U00010d24-\U00010d27\U00010eab\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85"
         r"\U00011070\U0001133b\U0001145e\U00011839\U0001183a\U00011930\U0001193d\U0001193e\U00011943\U000119e0\U00011a34"
         r"\U00011a47\U00011a99\U00011d42\U00011d44\U00011d45\U00011d97\U00011f41\U00011f42\U00016ff0\U00016ff1"
         r"\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef")
#: Lower case of letters that Python 3.13 does not know.
LOWER = ({0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
          0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)})
WORD = (rf"'s|'t|'re|'ve|'m|'ll|'d|(?:[^\P{{L}}{NEWER}])+|[^\P{{N}}{NEWER}]"
        rf"|(?:[{NEWER}]|[^{BLANK}\p{{L}}\p{{N}}])+")
#: Texts of these characters alone (ASCII, Latin letters and signs, dashes and quotes) need lower case but no other change
#: of the normaliser, and for them the word pattern is the one below: letters, endings, single digits, other signs.
LATIN = r"[\x00-\x1b -~\xa0-\u012f\u0131-\u017f\u2010-\u2027]*"
_LETTERS, _DIGITS = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_WORD = rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}\t-\r \xa0]+"
END = "</w>"
#: Words, and pieces between blanks, remembered by one task, and the longest of either.
REMEMBERED = 600_000
PIECES = 300_000
LONGEST = 64
#: Characters of Latin texts that are looked up together, and bytes of texts that a task gathers for it.
TOGETHER = 8_000_000
#: What str.split() takes for blanks and the word pattern does not.
OTHER_BLANKS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Pieces that hold one of these are cut by the general way.
ODD = ("<|", *OTHER_BLANKS)
POINTS = frozenset(".,;:!?")
#: How ids stand in bytes.
ID = np.dtype("<i4")
_NONE = np.int32(2**31 - 1)


def _rows(ids: np.ndarray) -> list[bytes]:
    raw, n = ids.astype(ID).tobytes(), ids.shape[1] * ID.itemsize
    return [raw[k:k + n] for k in range(0, len(raw), n)]


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free code point from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a vocabulary file of the BPE kind with word ends. Pickles by its path."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in merges]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self._key, self._rank = key[order], order.astype(np.int32)
        self._made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        letters = byte_letters()
        self._inner = np.array([vocab[c] for c in letters], np.int32)
        self._final = np.array([vocab[c + END] for c in letters], np.int32)
        self._word = regex.compile(WORD)
        self._latin, self._latin_word = re.compile(LATIN), re.compile(LATIN_WORD)
        self._alone = regex.compile(f"([{ALONE}])")
        self._upper = regex.compile("[" + "".join(map(chr, LOWER)) + "]")
        self._blank = regex.compile(f"[{BLANK}]+")
        self._cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self._known: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        self._forget()

    def __reduce__(self):
        return WordBpe, (self.path,)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self._key, want), len(self._key) - 1)
        return np.where(self._key[at] == want, self._rank[at], _NONE)

    def _merge(self, parts: np.ndarray) -> list[bytes]:
        """Words of one length, a row of part ids each."""
        out: list[bytes] = [b""] * len(parts)
        row = np.arange(len(parts))
        ranks = self._ranks(parts[:, :-1], parts[:, 1:]) if parts.shape[1] > 1 else np.empty((len(parts), 0), np.int32)
        while len(row):
            if not ranks.shape[1]:
                for i, p in zip(row.tolist(), _rows(parts), strict=True):
                    out[i] = p
                break
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), at]
            over = best == _NONE
            if over.any():
                for i, p in zip(row[over].tolist(), _rows(parts[over]), strict=True):
                    out[i] = p
                row, parts, ranks, at, best = row[~over], parts[~over], ranks[~over], at[~over], best[~over]
                if not len(row):
                    break
            n = parts.shape[1]
            each = np.arange(len(row))
            parts[each, at] = self._made[best]
            # delete the boundary: what stands behind moves up one place
            src = np.arange(n - 1)[None, :] + (np.arange(n - 1)[None, :] > at[:, None])
            parts = np.take_along_axis(parts, src, axis=1)
            if n == 2:
                ranks = np.empty((len(row), 0), np.int32)
                continue
            src = np.arange(n - 2)[None, :] + (np.arange(n - 2)[None, :] >= at[:, None])
            ranks = np.take_along_axis(ranks, src, axis=1)
            has = at > 0
            ranks[each[has], at[has] - 1] = self._ranks(parts[each[has], at[has] - 1], parts[each[has], at[has]])
            has = at < n - 2
            ranks[each[has], at[has]] = self._ranks(parts[each[has], at[has]], parts[each[has], at[has] + 1])
        return out

    def _learn(self, words: list[str]) -> None:
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode("utf-8")
            by_length.setdefault(len(b), []).append((w, b))
        for n, group in by_length.items():
            rows = max(1, 2_000_000 // n)
            for k in range(0, len(group), rows):
                some = group[k:k + rows]
                raw = np.frombuffer(b"".join(b for _, b in some), np.uint8).reshape(len(some), n)
                parts = self._inner[raw]
                parts[:, -1] = self._final[raw[:, -1]]
                self._known.update(zip((w for w, _ in some), self._merge(parts), strict=True))

    def words(self, text: str) -> list[str]:
        """Normalised words; a special token's string stands for itself."""
        if "<|" not in text:
            return self._plain(text)
        out: list[str] = []
        for piece in self._cut.split(text):
            out.extend([piece] if piece in self.special else self._plain(piece))
        return out

    def _normal(self, text: str) -> str:
        if not text.isascii():
            nfc = unicodedata.normalize
            text = ("".join(nfc("NFC", p) for p in self._alone.split(text)) if self._alone.search(text) else nfc("NFC", text))
            text = text.replace("Σ", "σ")  # sigma is lowered letter by letter
            if self._upper.search(text):
                text = text.translate(LOWER)
        return text.lower()

    def _plain(self, text: str) -> list[str]:
        return self._word.findall(self._blank.sub(" ", self._normal(text)))

    def _pieces_words(self, pieces: list[str]) -> list[list[str]]:
        """Words of each piece. Pieces without blanks are normalised together, a line each; letters alone,
        or with one point or comma behind, need no pattern."""
        find = self._word.findall
        lines = pieces
        joined = "\n".join(pieces)
        if any(c in joined for c in ODD):
            lines = ["" if any(c in p for c in ODD) else p for p in pieces]
            joined = "\n".join(lines)
        return [self.words(p) if not line and p else [line] if line.isalpha() else
                [line[:-1], line[-1]] if line[-1:] in POINTS and line[:-1].isalpha() else find(line)
                for p, line in zip(pieces, self._normal(joined).split("\n"), strict=True)]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        return [np.frombuffer(x, ID).tolist() for x in self.encode_packed(texts)]

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as ID bytes. No word, special token or change of the normaliser reaches over a blank, so texts
        are cut at blanks first, and pieces seen before are not cut into words again. Texts of Latin characters are cut
        and looked up many at once in Arrow."""
        latin = ["<|" not in t and self._latin.fullmatch(t) is not None for t in texts]
        ids = iter(self._by_numbers([t.lower() for t, plain in zip(texts, latin, strict=True) if plain]))
        rest = iter(self._by_pieces([t for t, plain in zip(texts, latin, strict=True) if not plain]))
        return [next(ids) if plain else next(rest) for plain in latin]

    def _by_numbers(self, texts: list[str]) -> list[bytes]:
        """Ids of lower-cased texts of Latin characters, some TOGETHER at a time: their pieces become numbers in the table
        of numbered pieces, which new ones join, and the ids are gathered by number."""
        out: list[bytes] = []
        lot = np.cumsum([len(t) for t in texts], dtype=np.int64) // TOGETHER
        for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(lot)) + 1) if texts else []:
            cut = pc.utf8_split_whitespace(pa.array(texts[some[0]:some[-1] + 1], pa.large_string()))
            pieces = cut.flatten()
            if len(self._numbered) > PIECES or self._numbered.nbytes > PIECES * LONGEST:
                self._forget()
            at = pc.index_in(pieces, value_set=self._numbered)
            number = at.fill_null(-1).to_numpy().astype(np.int64)
            if at.null_count:
                coded = pieces.filter(at.is_null()).dictionary_encode()
                number[number < 0] = coded.indices.to_numpy() + len(self._numbered)
                ids = self._ids(self._latin_words(coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
                size = np.fromiter(map(len, ids), np.int64, len(ids)) // ID.itemsize
                self._numbered = pa.concat_arrays([self._numbered, coded.dictionary])
                self._flat = np.concatenate([self._flat, np.frombuffer(b"".join(ids), ID)])
                self._end = np.concatenate([self._end, self._end[-1] + np.cumsum(size)])
            first, size = self._end[number], np.diff(self._end)[number]
            end = np.concatenate(([0], np.cumsum(size)))
            raw = self._flat[np.repeat(first - end[:-1], size) + np.arange(end[-1])].tobytes()
            out.extend(raw[a:b] for a, b in pairwise((end[cut.offsets.to_numpy()] * ID.itemsize).tolist()))
        return out

    def _forget(self) -> None:
        """Piece k of the empty table of numbered pieces will have the ids from _end[k] to _end[k + 1] of _flat."""
        self._numbered = pa.array([], pa.large_string())
        self._flat, self._end = np.empty(0, ID), np.zeros(1, np.int64)

    def _latin_words(self, pieces: list[str]) -> list[list[str]]:
        find = self._latin_word.findall
        return [[p] if p.isalpha() else find(p) for p in pieces]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        cut = [[t] if any(c in t for c in OTHER_BLANKS) else t.split() for t in texts]
        if len(self._pieces) > PIECES:
            self._pieces.clear()
        ids = self._pieces
        fresh = [p for p in set().union(*cut) if p not in ids]
        if fresh:
            ids.update(zip(fresh, self._ids(self._pieces_words(fresh)), strict=True))
        out = [b"".join(map(ids.__getitem__, c)) for c in cut]
        for piece in fresh:
            if len(piece) > LONGEST:
                del ids[piece]
        return out

    def _ids(self, cut: list[list[str]]) -> list[bytes]:
        """Ids of each list of words."""
        if len(self._known) > REMEMBERED:
            self._known.clear()
        known = self._known
        if not known:
            known.update({t: np.array([i], ID).tobytes() for t, i in self.special.items()})
        fresh = [w for w in set().union(*cut) if w not in known]
        if fresh:
            self._learn(sorted(fresh))
        out = [known[w[0]] if len(w) == 1 else b"".join(map(known.__getitem__, w)) for w in cut]
        for word in fresh:
            if len(word) > LONGEST:
                del known[word]
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by one space each."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(1)
def worker_bpe(path: str) -> WordBpe:
    """The coder of this Python worker: its words are remembered from task to task."""
    return WordBpe(path)


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row's ``keep`` columns (default: all) with ids (array<int>) and decoded (string).

    Null and empty texts have no ids and decode to the empty string. Special tokens' own strings in
    a text become their ids. Texts are processed whole. ``path`` is a file that every executor has.
    """
    text_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    coder = path

    def run(batches):
        bpe = worker_bpe(coder)
        for b in gathered(batches, len(types), TOGETHER):
            ids = bpe.encode_packed([t or "" for t in b.column(len(types)).to_pylist()])
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // ID.itemsize for x in ids], out=ends[1:])
            flat = np.frombuffer(b"".join(ids), ID)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(b.num_columns - 1)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                 pa.array([bpe.decode(np.frombuffer(x, ID).tolist()) for x in ids], pa.string())],
                names=[*b.schema.names[:-1], "ids", "decoded"])

    types = [rows.schema[i].dataType.simpleString() for i in range(len(keep))]
    schema = ", ".join([f"c{i} {t}" for i, t in enumerate(types)] + ["ids array<int>", "decoded string"])
    return rows.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "ids", "decoded")
