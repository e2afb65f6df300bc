"""Line-first cleaning with document rejection.

Each line with a word is judged by itself: it must end a sentence and not be
strewn with symbols, must not be a row of navigation links, and must hold no
boilerplate phrase (English, German, French or Spanish).  Failing lines are
removed; a document is rejected if that removes too large a share of its words,
or if it fails the base rules on the whole text (too few words, too much
repetition).  One pass over the texts, no shuffle; a worker holds one Arrow
batch, bounded by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerdesk.llm.common import bounded_batches

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
NOT_A_CODE_POINT = bytes(range(0x80, 0xC0))  # continuation bytes of UTF-8
TERMINAL = tuple(x.encode() for x in ". ! ? … 。 ！ ？ : ; \" ' ” ’ » ) ]".split())
SENTENCE_ENDS = (b". ", b"! ", b"? ")
SEPARATORS = tuple(x.encode() for x in ("|", "»", "›", "•", "·", " > ", " / "))
# Words of navigation links and phrases of boilerplate, per language.
_LINKS = {
    "en": (
        "home about contact login logout register search menu sitemap next previous back top "
        "share print subscribe help faq shop cart account"
    ),
    "de": (
        "startseite kontakt anmelden abmelden registrieren suche menü impressum weiter zurück "
        "teilen drucken abonnieren hilfe warenkorb konto datenschutz"
    ),
    "fr": (
        "accueil connexion déconnexion inscription recherche suivant précédent retour partager "
        "imprimer abonner aide boutique panier compte"
    ),
    "es": (
        "inicio contacto acceder salir registro buscar menú siguiente anterior atrás compartir "
        "imprimir suscribirse ayuda tienda carrito cuenta"
    ),
}
LINK_WORDS = frozenset(
    f(x).encode()
    for words in _LINKS.values()
    for x in words.split()
    for f in (str.lower, str.title, str.upper)
)
_PHRASES = {
    "en": (
        "cookie policy", "use of cookies", "privacy policy", "terms of use", "terms of service",
        "all rights reserved", "enable javascript", "javascript is disabled", "lorem ipsum",
        "click here", "sign up for our", "subscribe to our newsletter", "powered by",
        "skip to content", "skip to main content",
    ),
    "de": (
        "cookie-richtlinie", "verwendung von cookies", "datenschutzerklärung", "nutzungsbedingungen",
        "alle rechte vorbehalten", "javascript aktivieren", "hier klicken", "klicken sie hier",
        "newsletter abonnieren", "zum inhalt springen", "zum hauptinhalt springen",
    ),
    "fr": (
        "politique de cookies", "utilisation de cookies", "politique de confidentialité",
        "conditions d'utilisation", "conditions d’utilisation", "tous droits réservés",
        "activer javascript", "cliquez ici", "abonnez-vous à notre", "aller au contenu", "propulsé par",
    ),
    "es": (
        "política de cookies", "uso de cookies", "política de privacidad", "condiciones de uso",
        "términos de uso", "todos los derechos reservados", "habilitar javascript", "haga clic aquí",
        "haz clic aquí", "suscríbase a nuestro", "saltar al contenido", "ir al contenido",
    ),
}


def _spellings(phrase: str) -> tuple[str, str]:
    """As searched in text whose ASCII letters are lower-case: other letters in either case."""
    return phrase, "".join(c if c.isascii() else c.upper() for c in phrase)


PHRASES = tuple(
    dict.fromkeys(x.encode() for words in _PHRASES.values() for p in words for x in _spellings(p))
)

RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, n_lines long, "
    "bad_punctuation long, navigation long, boilerplate long, n_removed_words long"
)


def repeat_words(words: list[bytes], window: int = 5) -> int:
    """Words in windows of ``window`` words found twice or more, the first included.

    Windows are compared by hashes first; only a text with two equal hashes is
    counted by exact codes.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    code = h[:n].copy()
    for k in range(1, window):
        code *= np.uint64(0x9E3779B97F4A7C15)
        code += h[k : k + n]
    code.sort()
    if not (code[1:] == code[:-1]).any():
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    code, size = w[:n], len(ids)
    for k in range(1, window):
        if size > (1 << 62) // len(ids):
            found, code = np.unique(code, return_inverse=True)
            size = len(found)
        code = code * len(ids) + w[k : k + n]
        size *= len(ids)
    _, at, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[at] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def unpunctuated(line: bytes) -> bool:
    """Neither ends in terminal punctuation nor holds the end of a sentence."""
    return not (line.rstrip(WHITE).endswith(TERMINAL) or any(x in line for x in SENTENCE_ENDS))


def line_fault(line: bytes) -> int:
    """0: keep; 1: punctuation, 2: navigation, 3: boilerplate phrase."""
    words = line.split()
    links = sum(w in LINK_WORDS for w in words)
    seps = sum(map(line.count, SEPARATORS))
    if (seps >= 3 and 4 * (seps + 1) >= len(words)) or (links >= 3 and 2 * links >= len(words)):
        return 2
    low = line.lower()
    if any(x in low for x in PHRASES):
        return 3
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    return int(unpunctuated(line) or 2 * symbols > len(words))


def line_faults(text: bytes, words: list[bytes], lines: list[bytes]) -> list[int]:
    """``line_fault`` of every line; what the whole text lacks is not sought in its lines."""
    low = text.lower()
    if (
        any(x in text for x in SEPARATORS)
        or not LINK_WORDS.isdisjoint(words)
        or any(x in low for x in PHRASES)
        or len(text) > len(text.translate(None, SYMBOLS))
    ):
        return [line_fault(x) for x in lines]
    return [int(unpunctuated(x)) for x in lines]


def measure(text: bytes, max_removed: float) -> tuple:
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    repeated = repeat_words(words)
    base_failed = n < 10 or 100 * repeated > 20 * n
    faults = line_faults(text, words, lines)
    removed = sum(len(x.split()) for x, fault in zip(lines, faults, strict=True) if fault)
    return (
        n,
        len(text.translate(None, WHITE + NOT_A_CODE_POINT)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        base_failed,
        not base_failed and removed <= max_removed * n,
        len(lines),
        faults.count(1),
        faults.count(2),
        faults.count(3),
        removed,
    )


def clean_text(text: bytes) -> bytes:
    """``text`` without its failing lines (lines without a word stay)."""
    return b"\n".join(x for x in text.split(b"\n") if not x.strip(WHITE) or not line_fault(x))


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary"))


def judge(docs: DataFrame, max_removed: float = 0.5) -> DataFrame:
    """The base counts, the line rules' counts and the verdict of every document.

    ``max_removed``: largest share of its words that a kept document may lose.
    A null or empty text has no words and fails the base rules.  Rows are judged
    one by one, so repeated rows, null ids and ties need no rule; an empty table
    gives no rows.  Only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        kinds = [pa.bool_() if "boolean" in x else pa.int64() for x in RESULT.split(", ")]
        for batch in batches:
            rows = [measure(t or b"", max_removed) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * (len(names) - 1)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    bounded_batches(docs.sparkSession)
    return _narrow(docs).mapInArrow(run, RESULT)


def cleaned(docs: DataFrame, max_removed: float = 0.5) -> DataFrame:
    """doc_id and cleaned text of the kept documents (the operator's real output)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            keep = [measure(t, max_removed)[6] for t in texts]
            ids = batch.column(0).filter(pa.array(keep, pa.bool_()))
            out = [clean_text(t) for t, k in zip(texts, keep, strict=True) if k]
            texts = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, texts], names=["doc_id", "text"])

    bounded_batches(docs.sparkSession)
    return _narrow(docs).mapInArrow(run, "doc_id long, text string")
