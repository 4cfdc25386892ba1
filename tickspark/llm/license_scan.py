"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard
parser reads and evaluates the licence expressions behind the tags."""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import text_batches

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notice phrases that the method adds.
NOTICES = {"bsd license": "bsd", "mozilla public license": "mpl", "gnu lesser general public license": "lgpl",
           "gnu affero general public license": "agpl", "eclipse public license": "epl", "boost software license": "bsl",
           "public domain": "public-domain", "all rights reserved": "all-rights-reserved", "cc0": "cc0"}
TAG = "spdx license identifier"
#: How much a label restricts use, from 0 (free) to 1; tags of an unknown family count UNKNOWN.
RESTRICTS = {"public-domain": 0.0, "cc0": 0.0, "unlicense": 0.0, "mit": 0.1, "bsd": 0.1, "isc": 0.1, "bsl": 0.1, "zlib": 0.1,
             "apache": 0.2, "cc-by": 0.2, "mpl": 0.5, "epl": 0.5, "lgpl": 0.6, "gpl": 0.8, "agpl": 0.9, "all-rights-reserved": 1.0}
UNKNOWN = 0.7
#: Licence identifiers without a version.
NAMES = ("beerware", "curl", "eupl", "fsfap", "ftl", "hpnd", "icu", "ijg", "info-zip", "json", "libpng", "libtiff", "mirros", "ms-pl",
         "ms-rl", "ncsa", "ntp", "openssl", "postgresql", "psf", "ruby", "sleepycat", "tcl", "vim", "w3c", "wtfpl", "x11", "xnet", "zpl")
#: An exception (WITH) lifts this part of a licence's restriction.
EXCEPTION = 0.5

_WORD = bytes((c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)
              else 32 for c in range(256))
_TAG_LINE = re.compile(rb"spdx[- ]license[- ]identifier[ \t]*:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
#: Any other identifier is a name with a version behind a hyphen (apache-2.0, cc-by-sa-4.0-de), or a reference.
_IDENTIFIER = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+|[a-z][a-z0-9]*(?:-[a-z][a-z0-9]*)*-v?\d[a-z0-9.]*(?:-[a-z0-9.]+)*")
_PRIORITY = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str]:
    """Shunting-yard: the licence expression at the start of a line in postfix order. Reading stops at
    the first token that cannot continue it, words that are no licence identifier among them; unmatched
    brackets close at the end."""
    out, ops = [], []
    operand = True  # an operand (or an opening bracket) is due
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _PRIORITY:
            if operand:
                break
            while ops and ops[-1] != "(" and _PRIORITY[ops[-1]] >= _PRIORITY[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        elif token == "(":
            if not operand:
                break
            ops.append(token)
        elif token == ")":
            if operand or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        else:
            if not operand or not (is_identifier(low) or (ops and ops[-1] == "with")):
                break
            out.append(low)
            operand = False
    if operand and ops and ops[-1] != "(":
        ops.pop()  # an operator without its right side
    out.extend(op for op in reversed(ops) if op != "(")
    return out


def is_identifier(token: str) -> bool:
    """Whether a lower-case token can name a licence: a known family, a known name or the grammar of identifiers."""
    name = token.rstrip("+.")
    return family(token) in RESTRICTS or name in NAMES or _IDENTIFIER.fullmatch(name) is not None


def family(identifier: str) -> str:
    """apache-2.0 -> apache, gpl-2.0-or-later -> gpl, cc-by-4.0 -> cc-by."""
    name = identifier.rstrip("+.").split(":")[-1]
    return next((f for f in sorted(RESTRICTS, key=len, reverse=True) if name == f or name.startswith(f + "-")), name)


def evaluate(post: list[str]) -> tuple[set[str], float]:
    """Families named, and the restriction left: the milder side of OR, the stricter of AND, less by an
    exception for WITH (whose right side names no licence)."""
    stack: list[tuple[set[str], float]] = []
    for token in post:
        if token in _PRIORITY:
            if len(stack) < 2:
                continue
            (right, r), (left, l) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, l * EXCEPTION))
            else:
                stack.append((left | right, min(l, r) if token == "or" else max(l, r)))
        else:
            name = family(token)
            stack.append(({name}, RESTRICTS.get(name, UNKNOWN)))
    return set().union(*(s for s, _ in stack)), max((v for _, v in stack), default=0.0)


def automaton() -> ahocorasick.Automaton:
    """Phrases with a blank at either end, over words joined by single blanks."""
    found = ahocorasick.Automaton()
    for phrase, label in [*BASE.items(), *NOTICES.items(), (TAG, "")]:
        found.add_word(f" {phrase} ", (phrase, label, phrase in BASE))
    found.make_automaton()
    return found


def scan(text: str | None, found: ahocorasick.Automaton):
    """(n_words, n_base, first, last, base labels, labels, score, places) of one text."""
    raw = (text or "").encode()
    words = raw.translate(_WORD).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    at, base, labels, tagged, score = [], set(), set(), False, 0.0
    places = []
    for end, (phrase, label, is_base) in found.iter(line):
        start = end - len(phrase) - 1
        places.append((start, phrase, label, is_base))
    if places:
        blanks = np.cumsum(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        spots = []
        for start, phrase, label, is_base in places:
            word = int(blanks[start]) - 1
            spots.append((word, phrase))
            if is_base:
                at.append(word)
                base.add(label)
            if label:
                labels.add(label)
                score = max(score, RESTRICTS[label])
            else:
                tagged = True
        places = spots
    if tagged:
        for m in _TAG_LINE.finditer(raw):
            names, value = evaluate(postfix(m[1].decode("utf-8", "replace")))
            labels |= names
            score = max(score, value)
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), score, places)


_OUT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "places array<struct<word:bigint,phrase:string>>")
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
          pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string())]))]


def _scan(batches):
    found = automaton()
    names = [c.split(" ")[0] for c in _OUT.split(", ")]
    for b in batches:
        rows = [scan(t, found) for t in b.column(1).to_pylist()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
        cols = [list(c) for c in cols]
        cols[7] = [[{"word": w, "phrase": p} for w, p in spots] for spots in cols[7]]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True))],
                                         names=["doc_id", *names])


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of ``docs``: doc_id, n_words, n_base (places of base phrases), first_word and
    last_word (their smallest and largest start, words from 0, else null), base_labels and labels
    (distinct, sorted, comma-joined; labels also holds notices and the families of tagged
    expressions; words behind a tag that are no identifier give none), score (0 to 1: the strictest thing found, 0 if none), places (every phrase's).

    Only A-Z are lower-cased. Null and empty texts have no words, empty labels and score 0. Null and
    repeated ids are carried as they are. Overlapping places all count. Other columns play no role.
    """
    text_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_scan, "doc_id long, " + _OUT)
