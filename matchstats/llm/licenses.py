"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags; tag expressions are parsed."""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matchstats.llm.shared import WORD_BYTES, binaries, words_of

#: The phrases of the base labels, as words.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further phrases of the method.
MORE = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "isc license": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Fixed value: the words of an identifier tag, which the automaton finds, and how the tag is written in the text.
TAG_WORDS, TAG = "spdx license identifier", b"spdx-license-identifier:"
#: Families of licence identifiers: an identifier is of a family if it is the name, or goes on with `-`, `+` or a version.
FAMILIES = ("apache", "lgpl", "agpl", "gpl", "mit", "bsd", "mpl", "isc", "cc-by", "unlicense")
_FAMILY = re.compile(rf"({'|'.join(FAMILIES)})(?:[-+].*|v?[0-9].*)?")
#: Further identifiers without a hyphen, and with hyphens but without a version.
PLAIN = frozenset("0bsd aal afmparse artistic beerware borceux curl eurosym ftl ijg info-zip intel json leptonica libpng libtiff naumen ncsa netcdf newsletr noweb ntp openssl plexus postgresql python ruby saxpath sendmail sleepycat sgi spl sugarcrm tcl vim vsl w3c watcom wtfpl x11 xfree86 xinetd xnet xpp zed zlib zpl".split())
UNVERSIONED = frozenset("adobe-glyph adobe-utopia bitstream-vera gnu-all-permissive hpnd-sell-variant ibm-pibs intel-acpi linux-openib linux-syscall-note ms-lpl ms-pl ms-rl nist-pd nist-pd-fallback sax-pd standardml-nj tcp-wrappers unicode-tou".split())
#: Any other hyphenated identifier has a part that begins with a version's digit, is an exception, or is marked as a reference.
_HYPHENATED = re.compile(r"(?:licenseref|documentref)-[a-z0-9.-]+|[a-z0-9][a-z0-9.]*(?:-[a-z0-9.+]+)*-(?:[0-9][a-z0-9.+]*|exception)(?:-[a-z0-9.+]+)*\+?")
#: An expression ends before these.
STOPS = re.compile(r"\*/|-->|[;,\"'`\r\n]")
PERMISSIVE = frozenset({"mit", "apache", "bsd", "isc", "unlicense", "0bsd", "zlib"})
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Operators and how tightly they bind.
BINDING = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """A licence expression in postfix order by the shunting-yard method; None if it is malformed."""
    out, stack, operand = [], [], False
    for token in re.findall(r"[()]|[^\s()]+", expression.lower()):
        if token in BINDING:
            if not operand:
                return None
            while stack and stack[-1] != "(" and BINDING[stack[-1]] >= BINDING[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = False
        elif token == "(":
            if operand:
                return None
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack or not operand:
                return None
            stack.pop()
        elif operand or not re.fullmatch(r"[a-z0-9.+:-]+", token):
            return None
        else:
            out.append(token)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def family(identifier: str) -> str | None:
    """The label of an identifier: its family, or itself; None of a word that is no identifier."""
    if m := _FAMILY.fullmatch(identifier):
        return m[1]
    return identifier if identifier in PLAIN or identifier in UNVERSIONED or _HYPHENATED.fullmatch(identifier) else None


def evaluate(order: list[str], allowed: frozenset[str] = PERMISSIVE) -> tuple[bool, set[str]]:
    """Whether a choice of the expression's licences is allowed (`with` adds an exception and keeps its licence's
    answer), and the labels of the licences it names."""
    stack: list[bool] = []
    found: set[str] = set()
    exceptions = {i - 1 for i, t in enumerate(order) if t == "with"}
    for i, token in enumerate(order):
        if token not in BINDING:
            stack.append(family(token) in allowed)
            if i not in exceptions and (f := family(token)):
                found.add(f)
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left if token == "with" else left and right if token == "and" else left or right)
    return stack[0], found


def longest(text: str) -> list[str]:
    """The tokens of the longest beginning of a lower-cased text that is an expression; none if no beginning is one.

    One pass: it ends at the first token that no expression can have there, and remembers where one last was whole.
    An identifier's closing full stops and colons belong to the sentence, which ends the expression.
    """
    tokens, whole, depth, before, ends = [], 0, 0, "(", ("licence", "exception", ")")
    for token in (m[0] for m in re.finditer(r"[()]|[^\s()]+", text)):
        bare = token.rstrip(".:")
        if token in BINDING:
            if before not in ends or token == "with" and before != "licence":
                break
            before = token
        elif token == "(":
            if before not in ("(", "and", "or"):
                break
            depth, before = depth + 1, "("
        elif token == ")":
            if before not in ends or not depth:
                break
            depth, before = depth - 1, ")"
        elif before in ends or not family(bare):
            break
        else:
            before = "exception" if before == "with" else "licence"
        tokens.append(bare or token)
        if not depth and before in ends:
            whole = len(tokens)
        if bare and bare != token:
            break
    return tokens[:whole]


def tags(raw: bytes, starts: list[int]) -> tuple[list[str], bool, set[str]]:
    """Valid identifier expressions after the tags whose first word has one of the given numbers, whether all of them
    are permissive, and the labels they name.  A tag's expression ends with its line, or at the next tag."""
    spaced = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32
    edge = np.diff(spaced.astype(np.int8), prepend=0)
    begins = np.flatnonzero(edge == 1)[starts].tolist()
    good, free, found = [], True, set()
    for begin, nxt in zip(begins, [*begins[1:], len(raw)]):
        if raw[begin : begin + len(TAG)].lower() != TAG:
            continue
        line = raw[begin + len(TAG) : nxt]
        stop = re.search(rb"[\r\n]", line)
        rest = STOPS.split(line[: stop.start() if stop else None].decode("utf-8", "replace").translate(LOWER), maxsplit=1)[0]
        if tokens := longest(rest):
            ok, own = evaluate(postfix(" ".join(tokens)))
            good.append(" ".join(tokens).replace("( ", "(").replace(" )", ")"))
            free, found = free and ok, found | own
    return good, free, found


def automaton(phrases: dict[str, str]) -> ahocorasick.Automaton:
    """An automaton of the phrases and, numbered after them, of the words of an identifier tag."""
    a = ahocorasick.Automaton()
    for i, phrase in enumerate([*phrases, TAG_WORDS]):
        a.add_word(f" {phrase} ", (i, phrase))
    a.make_automaton()
    return a


def scan_text(raw: bytes | None, machine: ahocorasick.Automaton, phrases: dict[str, str], n_base: int) -> dict:
    """All phrase and tag places of one text, judged on whole words; offsets are word numbers from 0."""
    words = words_of(raw)
    line = " " + b" ".join(words).decode() + " "
    # Matches may share their border blank, which the automaton reports all the same.
    hits = [(end - len(phrase) - 1, i) for end, (i, phrase) in machine.iter(line)] if words else []
    base, starts, names = 0, None, list(phrases)
    expressions, free, families = [], True, set()
    if hits:
        blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
        numbers = np.searchsorted(blanks, np.array([at for at, _ in hits])).tolist()
        if tagged := sorted(n for n, (_, i) in zip(numbers, hits) if i == len(names)):
            expressions, free, families = tags(raw, tagged)
        base_starts = [n for n, (_, i) in zip(numbers, hits) if i < n_base]
        if base_starts:
            starts, base = np.array(base_starts), len(base_starts)
    hits = [i for _, i in hits if i < len(names)]
    base_labels = {phrases[names[i]] for i in hits if i < n_base}
    named = {phrases[names[i]] for i in hits}
    score = 1.0 if expressions else 1.0 - 0.5 ** len(hits)
    return {
        "n_words": len(words), "n_base": base,
        "first_word": int(starts.min()) if base else None, "last_word": int(starts.max()) if base else None,
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(named | families)), "score": score,
        "expressions": expressions, "permissive": bool(named or expressions) and named <= PERMISSIVE and free,
    }


COLUMNS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(),
    "labels": pa.string(), "score": pa.float64(), "expressions": pa.list_(pa.string()), "permissive": pa.bool_(),
}


def scan(docs: DataFrame, base: dict[str, str] = BASE, more: dict[str, str] = MORE) -> DataFrame:
    """Licence findings of every whole text, by a narrow pass; only doc_id and text are read.

    Null or empty texts have no words, no labels and score 0; repeated rows are scanned each for itself; texts and
    expressions may be of any length.  labels are those of the phrases and of all licences that expressions name, an
    identifier of no known family being its own label; permissive says whether all phrases' labels are permissive and
    every expression leaves a permissive choice.  The score is 1 where a valid identifier expression stands, else
    1 - 0.5 to the power of the number of phrase places.
    """

    def run(batches):
        phrases = {**base, **more}
        machine = automaton(phrases)
        for batch in batches:
            texts = binaries(batch, "text")
            for at in range(0, len(texts), 2000):
                found = [scan_text(t, machine, phrases, len(base)) for t in texts[at : at + 2000]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, 2000)] + [pa.array([f[c] for f in found], k) for c, k in COLUMNS.items()], ["doc_id", *COLUMNS]
                )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
