"""License scans: identifier tags and notice phrases by Aho-Corasick, licence expressions by a shunting-yard parser.

Text is lower-cased (A-Z) and cut into words; one automaton over the words of
all phrases and of the public SPDX identifiers finds every place in one pass.
Where the SPDX tag occurs, the expression behind it is parsed and its licences
become labels. An expression ends before the first word that is no identifier.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# The contract's phrases and labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# The method's own: notices and the names of common licences.
MORE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons": "cc",
    "public domain": "public-domain",
    "permission is hereby granted": "permissive-notice",
    "redistribution and use in source and binary forms": "bsd-notice",
    "licensed under the apache": "apache",
    "released under the mit": "mit",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "python software foundation license": "psf",
    "european union public licence": "eupl",
    "open font license": "ofl",
    "open database license": "odbl",
    "academic free license": "afl",
    "eclipse distribution license": "edl",
    "server side public license": "sspl",
    "business source license": "busl",
    "gnu free documentation license": "gfdl",
    "attribution noncommercial": "cc-nc",
    "attribution sharealike": "cc-sa",
    "no rights reserved": "cc0",
    "copyright c": "copyright",
    "proprietary and confidential": "proprietary",
    "provided as is without warranty": "no-warranty",
    "without warranty of any kind": "no-warranty",
}
# SPDX identifiers in lower case, by family and versions.
VERSIONS = {
    "afl": "1.1 1.2 2.0 2.1 3.0",
    "apache": "1.0 1.1 2.0",
    "apsl": "1.0 1.1 1.2 2.0",
    "artistic": "1.0 2.0",
    "blueoak": "1.0.0",
    "bsl": "1.0",
    "busl": "1.1",
    "cc0": "1.0",
    "cddl": "1.0 1.1",
    "cecill": "1.0 1.1 2.0 2.1",
    "cpl": "1.0",
    "ecl": "1.0 2.0",
    "elastic": "2.0",
    "epl": "1.0 2.0",
    "eupl": "1.0 1.1 1.2",
    "lppl": "1.0 1.1 1.2 1.3a 1.3c",
    "mpl": "1.0 1.1 2.0",
    "mulanpsl": "1.0 2.0",
    "nposl": "3.0",
    "odbl": "1.0",
    "odc-by": "1.0",
    "ofl": "1.0 1.1",
    "osl": "1.0 1.1 2.0 2.1 3.0",
    "pddl": "1.0",
    "php": "3.0 3.01",
    "psf": "2.0",
    "python": "2.0 2.0.1",
    "qpl": "1.0",
    "rpl": "1.1 1.5",
    "sspl": "1.0",
    "unicode": "3.0",
    "unicode-dfs": "2015 2016",
    "upl": "1.0",
    "vsl": "1.0",
    "zpl": "1.1 2.0 2.1",
}
# Each of their versions also has the forms -only and -or-later.
GNU_VERSIONS = {"agpl": "1.0 3.0", "gfdl": "1.1 1.2 1.3", "gpl": "1.0 2.0 3.0", "lgpl": "2.0 2.1 3.0"}
CREATIVE = "cc-by cc-by-nc cc-by-nc-nd cc-by-nc-sa cc-by-nd cc-by-sa"
CREATIVE_VERSIONS = "1.0 2.0 2.5 3.0 4.0"
UNVERSIONED = (
    "0bsd bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-3-clause-lbnl bsd-4-clause bsd-source-code curl fsfap hpnd icu ijg isc json libpng libpng-2.0 mit mit-0 ms-pl ms-rl ncsa ntp openssl postgresql ruby sleepycat tcl unlicense vim wtfpl x11 zlib"
)
#: Names of programs too: their identifiers count behind a tag only.
_PROGRAMS = ("php-", "python-", "unicode-", "elastic-")


def _identifiers() -> frozenset[str]:
    out = {f"{f}-{v}" for f, versions in VERSIONS.items() for v in versions.split()}
    out |= {f"{f}-{v}{form}" for f, versions in GNU_VERSIONS.items() for v in versions.split() for form in ("", "-only", "-or-later")}
    out |= {f"{f}-{v}" for f in CREATIVE.split() for v in CREATIVE_VERSIONS.split()}
    return frozenset(out | set(UNVERSIONED.split()))


IDENTIFIERS = _identifiers()
#: Identifiers of several words, found anywhere in a text. One of a single word may be any word ("mit").
NAMED_PHRASES = {phrase: i for i in sorted(IDENTIFIERS) if " " in (phrase := re.sub("[-.]", " ", i)) and not i.startswith(_PROGRAMS)}
# The usual short forms of the GNU licences.
NAMED_PHRASES |= {f"{f}{gap}v{v}": f"{f}-{v}.0" for f in ("agpl", "gpl", "lgpl") for gap in ("", " ") for v in (2, 3) if f"{f}-{v}.0" in IDENTIFIERS}
TAG = "spdx license identifier"
# Licences that ask for no more than notice.
PERMISSIVE = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib"})
_EXPRESSION = re.compile(r"(?i:SPDX-License-Identifier)[ \t]*:[ \t]*([A-Za-z0-9.+:() \t-]+)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
# How tightly the operators of an expression bind.
_BINDS = {"or": 1, "and": 2, "with": 3}
_EXCEPTION = re.compile(r"[a-z0-9.-]+-(exception|note)(-[0-9.]+)?|additionref-[a-z0-9.-]+")
_OWN = re.compile(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
# Bytes that part words become blanks and A-Z lower case; bytes from 128 up belong to words.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def is_operand(token: str, exception: bool) -> bool:
    """Whether a lower-case token is a licence (a known one, perhaps with a plus, or one's own) or, behind `with`, an exception."""
    if exception:
        return _EXCEPTION.fullmatch(token) is not None
    return token.removesuffix("+") in IDENTIFIERS or _OWN.fullmatch(token) is not None


def to_postfix(expression: str) -> list[str] | None:
    """An expression's operands and operators in postfix order, lower-cased; None where it isn't well formed.

    It ends before the first word that cannot follow what stands before it, as
    tags are often followed by prose: before a word that is no operand, and
    before the operator in front of that word.
    """
    out: list[str] = []
    held: list[str] = []
    depth, operand = 0, False  # operand: the last token ended one
    for token in (t.lower().rstrip(".") or "." for t in _TOKEN.findall(expression)):
        if token == "(":
            if operand:
                break
            held.append(token)
            depth += 1
        elif token == ")":
            if not operand or not depth:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        elif token in _BINDS:
            if not operand:
                return None
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[token]:
                out.append(held.pop())
            held.append(token)
            operand = False
        else:
            if operand:
                break
            after = held[-1] if held else None
            if not is_operand(token, after == "with"):
                if after in _BINDS:
                    held.pop()
                    operand = True
                break
            out.append(token)
            operand = True
    if depth or not operand:
        return None
    return out + held[::-1]


def evaluate(postfix: list[str], allowed: frozenset[str] = PERMISSIVE) -> tuple[list[str], bool]:
    """An expression's licences and whether the allowed ones alone satisfy it.

    `x with y` is the one licence x-with-y, at its own place; an exception
    behind a bracket goes to each licence in it. An exception never forbids what
    its licence allows.
    """
    stack: list[tuple[list[str], bool]] = []
    for token in postfix:
        if token not in _BINDS:
            stack.append(([token], token in allowed))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if token == "with":
            stack.append(([f"{x}-with-{y}" for x in a for y in b], left))
        else:
            stack.append((a + b, left or right if token == "or" else left and right))
    return sorted(set(stack[0][0])), stack[0][1]


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrase, label in (NAMED_PHRASES | MORE_PHRASES | BASE_PHRASES | {TAG: None}).items():
        out.add_word(f" {phrase} ", (phrase, label, len(phrase.split()), phrase in BASE_PHRASES))
    out.make_automaton()
    return out


def scan_text(text: str) -> dict:
    """Words and places of one text: n_words, places [(first word, words, phrase, label, base)], expressions [(text, licences, permitted)]."""
    words = text.encode("utf-8", "surrogatepass").translate(_BYTES).split()
    plain = b" ".join((b"", *words, b"")).decode("latin-1")
    places, at, passed, tagged = [], 0, 0, False
    for end, (phrase, label, n, base) in _automaton().iter(plain):
        passed += plain.count(" ", at, end)
        at = end
        if label is None:
            tagged = True
        else:
            places.append((passed - n, n, phrase, label, base))
    expressions = []
    if tagged:
        for m in _EXPRESSION.finditer(text):
            if postfix := to_postfix(m[1]):
                expressions.append((m[1].strip(), *evaluate(postfix)))
    return {"n_words": len(words), "places": places, "expressions": expressions}


def find_licenses(docs: DataFrame, max_chars: int = 2_000_000) -> DataFrame:
    """doc_id, n_words, places array<struct<word, words, phrase, label, base>>, expressions array<struct<text, licences, permitted>>.

    docs has doc_id and text; other columns are ignored, whatever their names.
    Null text counts as empty. Each row is read by itself, so repeated rows and
    ids repeat their result; an empty table gives an empty one. Texts of any
    length are read whole, held max_chars at a time or one by one.
    """
    place = pa.struct([("word", pa.int64()), ("words", pa.int64()), ("phrase", pa.string()), ("label", pa.string()), ("base", pa.bool_())])
    expression = pa.struct([("text", pa.string()), ("licences", pa.list_(pa.string())), ("permitted", pa.bool_())])

    def scan(batches):
        for batch in batches:
            for part, texts in slices(batch, "text", max_chars):
                found = [scan_text(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([f["n_words"] for f in found], pa.int64()),
                        pa.array([[dict(zip(("word", "words", "phrase", "label", "base"), p, strict=True)) for p in f["places"]] for f in found], pa.list_(place)),
                        pa.array([[dict(zip(("text", "licences", "permitted"), x, strict=True)) for x in f["expressions"]] for f in found], pa.list_(expression)),
                    ],
                    ["doc_id", "n_words", "places", "expressions"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_words bigint, places array<struct<word:bigint,words:bigint,phrase:string,label:string,base:boolean>>, expressions array<struct<text:string,licences:array<string>,permitted:boolean>>")


def license_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document, and permitted: whether permissive licences alone satisfy all of its expressions; null where it has none. score: 1 less a half for each place or expression found."""
    base = F.filter("places", lambda p: p["base"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    named = F.transform("places", lambda p: p["label"])
    of_base = F.transform(base, lambda p: p["label"])
    expressed = F.flatten(F.transform("expressions", lambda e: e["licences"]))
    starts = F.transform(base, lambda p: p["word"])
    return find_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(of_base).alias("base_labels"),
        listed(F.concat(named, expressed)).alias("labels"),
        (1 - F.pow(F.lit(0.5), F.size("places") + F.size("expressions"))).alias("score"),
        F.when(F.size("expressions") > 0, F.forall("expressions", lambda e: e["permitted"])).alias("permitted"),
    )
