"""Line-first cleaning and document quality rules.

Every line is judged by punctuation, navigation and boilerplate rules. Failing
lines go; a document goes if it fails the base rules, or if the failing lines
hold more than MOST_LOST of its word characters. All of a text is read; lines
without a word are never judged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, blocks

#: Largest share of its word characters that a kept document may lose.
MOST_LOST = 0.5
#: A document has at least so many words, and at most this share of them in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
WINDOW = 3
# Symbols counted by the base rules, separators of menus, sentence marks.
SYMBOLS = b"#*$%&|<>"
SEPARATORS = (b"|", "»".encode(), "›".encode(), "•".encode(), "·".encode(), b" > ")
SENTENCE_MARK = re.compile("|".join(["[.!?,;:]", *"…。！？،؟"]).encode())  # whole marks: a class would take their single bytes
# Phrases of licences, legal notices and site furniture.
BOILERPLATE = re.compile(
    rb"all rights reserved|\blicen[sc]ed under\b|\breleased under the\b|\blicense, version\b|terms of (use|service)"
    rb"|privacy policy|cookie (policy|settings)|accept (all )?cookies|subscribe to our newsletter|sign up for our"
    rb"|share (this )?on (facebook|twitter)|follow us on|click here to|\bcopyright \(c\)|enable javascript|skip to (main )?content",
    re.IGNORECASE,
)
#: Longest line, in words, that a boilerplate phrase condemns.
BOILERPLATE_WORDS = 30
# Words of menus, which need no separators, in the languages that occur.
MENU = frozenset(
    "home about contact login logout register help sitemap search menu faq careers blog news products services support account cart checkout shop privacy terms imprint"
    " us our sign in up log out my next previous back top more"
    " startseite kontakt impressum datenschutz anmelden registrieren hilfe suche warenkorb konto agb"
    " accueil connexion inscription aide recherche panier compte mentions légales"
    " inicio contacto acceder registrarse ayuda buscar carrito cuenta aviso legal".split()
)
#: Longest line, in words, that is a menu if all its words are menu words, half of them by themselves.
MENU_WORDS = 12
# Words that are menu words only beside others.
MENU_LINKS = frozenset("us our sign in up log out my next previous back top more legal mentions".split())


def line_rule(line: bytes) -> str | None:
    """The rule a line fails, or None. A line without a word fails none."""
    words = line.split()
    if not words:
        return None
    n, solid = len(words), b"".join(words)
    if n >= 3 and sum(line.count(s) for s in SEPARATORS) >= max(2, n / 4):
        return "navigation"
    if 2 <= n <= MENU_WORDS and (low := line.decode().lower().split()) and MENU.issuperset(low) and 2 * sum(w not in MENU_LINKS for w in low) >= n:
        return "navigation"
    if n <= BOILERPLATE_WORDS and BOILERPLATE.search(line):
        return "boilerplate"
    marks = len(solid) - len(solid.translate(None, SYMBOLS))
    if marks > 0.15 * len(solid):
        return "punctuation"
    if n >= 5 and line.count(b"!!") > n / 4:
        return "punctuation"
    if n >= 8 and not SENTENCE_MARK.search(line):
        return "punctuation"
    return None


def clean_lines(data: bytes) -> tuple[bytes, int, int]:
    """The text without its failing lines; word characters (bytes) before and lost."""
    kept, total, lost = [], 0, 0
    for line in data.split(b"\n"):
        n = sum(map(len, line.split()))
        total += n
        if line_rule(line):
            lost += n
        else:
            kept.append(line)
    return b"\n".join(kept), total, lost


def repeated_words(ids: np.ndarray) -> int:
    """Words inside windows of WINDOW words that occur twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    keys, base = ids[:n].astype(np.int64), int(ids.max()) + 1
    for k in range(1, WINDOW):
        if k > 1 and base**3 >= 1 << 63:  # numbered anew, so that codes stay exact in texts of millions of distinct words
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * base + ids[k : k + n]
    _, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    covered = np.zeros(len(ids), bool)
    twice = counts[place] > 1
    for k in range(WINDOW):
        covered[k : k + n] |= twice
    return int(covered.sum())


def _measures(texts: list[bytes]) -> dict[str, list]:
    split = [t.split() for t in texts]
    codes, _ = pd.factorize(np.array([w for words in split for w in words] + [b""], object)[:-1])
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_share", "cleaned")}
    at = 0
    for text, words in zip(texts, split, strict=True):
        n = len(words)
        _, dense = np.unique(codes[at : at + n], return_inverse=True)
        at += n
        repeated = repeated_words(dense) if n else 0
        lines = [x for x in text.split(b"\n") if x.strip()]
        failed = n < LEAST_WORDS or repeated > MOST_REPEATED * n
        cleaned, total, lost = clean_lines(text)
        out["n_words"].append(n)
        out["word_chars"].append(len(b"".join(words).decode()))
        out["n_symbols"].append(len(text) - len(text.translate(None, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_repeat_words"].append(repeated)
        out["base_failed"].append(failed)
        out["kept"].append(not failed and lost <= MOST_LOST * total)
        out["lost_share"].append(lost / total if total else 0.0)
        out["cleaned"].append(cleaned)
    return out


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_share double"


def quality_rules(docs: DataFrame) -> DataFrame:
    """Measures and verdict of each document.

    Null text has no words and fails the base rules. Repeated rows give
    repeated results, a null doc_id stays null, other columns are not read, and
    an empty table gives no rows.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = _measures(as_bytes(block.column("text")))
            found.pop("cleaned")
            yield pa.RecordBatch.from_pydict({"doc_id": block.column("doc_id").cast(pa.int64())} | found)

    return docs.select("doc_id", "text").mapInArrow(judge, COLUMNS)


def clean_documents(docs: DataFrame) -> DataFrame:
    """The kept documents with all their columns; text without failing lines, n_chars to match if there is one.

    Null and empty texts fail the base rules and go. Rows are judged one by one,
    so repeated rows and null keys are treated like any other; columns of any
    other name are passed on; an empty table gives no rows.
    """
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = _measures(as_bytes(block.column("text")))
            columns = {c: block.column(c) for c in names}
            texts = [t.decode() for t in found["cleaned"]]
            columns["text"] = pa.array(texts, block.column("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(map(len, texts), pa.int64()).cast(block.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names).filter(pa.array(found["kept"], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
