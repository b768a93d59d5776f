"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order of kinds in every list of spans; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "name", "secret")
BASE = KINDS[:4]
LABELERS = ("regex", "gazetteer", "context", "structure")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match that fails from the first digit of a run fails from its other digits too, so only first digits start one.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Candidates beyond the base kinds: written-out addresses, national numbers, account and identity numbers, titled names, keys and passwords.
_DOT = r"(?: dot |\s?[\[(]dot[\])]\s?)"
_WRITTEN = re.compile(rf"(?i)\b[a-z0-9._%+-]{{1,64}}(?:\s?[\[(]at[\])]\s?[a-z0-9-]{{1,63}}(?:(?:{_DOT}|\.)[a-z0-9-]{{2,63}}){{1,4}}| at [a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{2,63}}){{1,4}})\b")
_WRITTEN_HINTS = (" dot ", "[at]", "(at)", "[dot]", "(dot)")
_NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_LONG = re.compile(r"(?<![0-9])[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{3,5}(?![0-9])")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
_NAME = re.compile(rf"\b(?:{'|'.join(_TITLES)})\.? [A-Z][\w'-]{{1,30}}(?: [A-Z][\w'-]{{1,30}})?")
#: The value that a key word is set to, or a long run of letters and digits that stands alone.
_KEY_WORDS = ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "access_key", "private_key", "auth", "bearer", "passwort", "contraseña", "clave")
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z0-9_/+=-]*[0-9])(?=[A-Za-z0-9_/+=-]*[A-Za-z])[A-Za-z0-9_/+=-]{12,512}(?![A-Za-z0-9_/+=-])")
_ISSUED = re.compile(r"AKIA[0-9A-Z]{16}\Z|gh[pousr]_|xox[abprs]-|sk-|sk_live_|AIza|eyJ")
_SET = re.compile(rf"(?i)(?:{'|'.join(_KEY_WORDS)})[\"']?\s*(?:[:=]|=>|is)?\s*[\"']?\Z")

# Fixed values of the labelers.
TLDS = frozenset("com org net edu gov mil int info biz name pro app dev xyz online site shop cloud example test".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
IBAN_LENGTHS = {"AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26}
GIVEN_NAMES = frozenset(
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark paul steven andrew kevin brian george edward "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret sandra ashley emily donna michelle carol amanda anna emma "
    "hans karl peter klaus jürgen wolfgang dieter uwe stefan andreas markus ursula monika petra sabine heike julia katharina lena "
    "pierre jean luc michel jacques philippe nicolas françois marie nathalie isabelle sylvie catherine camille "
    "josé juan carlos antonio manuel francisco luis miguel javier pedro maría carmen ana isabel laura sofía lucía marta elena".split()
)
#: Words that announce a kind, whole words within CONTEXT_CHARS before a span.
CONTEXT = {
    "email": frozenset("mail email e-mail contact contacto kontakt write address adresse correo courriel reach".split()),
    "ip": frozenset("ip ipv4 host server address from client login logged serveur servidor".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte kreditkarte carte tarjeta".split()),
    "phone": frozenset("phone call tel telephone mobile cell fax whatsapp telefon handy téléphone teléfono móvil".split()),
    "iban": frozenset("iban account bank konto bankverbindung compte cuenta transfer".split()),
    "ssn": frozenset("ssn social security tax steuer identification".split()),
    "name": frozenset("name named signed dear contact by from sincerely regards".split()),
    "secret": frozenset("key keys credentials credential login".split()) | frozenset(_KEY_WORDS),
}
CONTEXT_CHARS = 40
_WORD = re.compile(r"[\w-]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """The check digit of a card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping addresses, found from each @ outwards: linear in the text."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the four base kinds, by kind, then start. Matches that fail their check are dropped and not retried."""
    out = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans that may be personal data beyond the base ones; none overlaps a base span."""
    found: list[Span] = []
    low = text.lower()
    if any(h in low for h in _WRITTEN_HINTS):
        found += [("email", *m.span()) for m in _WRITTEN.finditer(text)]
    if _DIGIT.search(text):
        found += [("card", *m.span()) for m in _LONG.finditer(text)]
        found += [("phone", *m.span()) for m in _NATIONAL.finditer(text)]
        found += [("iban", *m.span()) for m in _IBAN.finditer(text)]
        found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        found += [("secret", *m.span()) for m in _SECRET.finditer(text)]
    if any(t in text for t in _TITLES):
        found += [("name", *m.span()) for m in _NAME.finditer(text)]
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    ends = np.maximum.accumulate([e for _, e in taken]) if taken else []
    out = []
    for k, s, e in found:
        i = int(np.searchsorted(starts, e)) if taken else 0
        if not i or ends[i - 1] <= s:
            out.append((k, s, e))
    return out


def votes(text: str, span: Span) -> tuple[int, ...]:
    """A vote of each labeler: 1 personal data, -1 not, 0 abstains; the last value is a shape class, not a vote."""
    kind, start, end = span
    s = text[start:end]
    digits = _NOT_DIGIT.sub("", s)
    before = text[max(0, start - CONTEXT_CHARS) : start].lower()
    context = 1 if not CONTEXT[kind].isdisjoint(_WORD.findall(before)) else 0
    if kind == "email":
        plain = "@" in s
        tld = re.split(r"[\s.\])]+", s.strip("])"))[-1].lower()
        # every country has a domain of two letters
        return (1 if plain else 0, 1 if tld in TLDS or (len(tld) == 2 and tld.isalpha()) else -1, context, 1 if plain or re.search(r"[\[(]", s) else -1, int(plain))
    if kind == "ip":
        parts = [int(p) for p in s.split(".")]
        return (1, -1 if parts[0] in (0, 127, 255) else 1, context, 1 if parts[0] >= 10 else -1, 0)
    if kind == "card":
        full = 16 <= len(digits) <= 19
        return (1 if full else 0, 1 if digits[0] in "3456" else -1, context, 1 if luhn(digits) else -1, int(full))
    if kind == "phone":
        intl = s[0] == "+"
        code = any(digits.startswith(c) for c in CALLING_CODES)
        return (1 if intl else 0, (1 if code else -1) if intl else 0, context, 1 if re.search(r"[ ().-]", s) and len(digits) >= 10 else -1, int(intl))
    if kind == "iban":
        return (1, 1 if IBAN_LENGTHS.get(s[:2]) == len(s.replace(" ", "")) else -1, context, 1 if _iban_ok(s) else -1, 0)
    if kind == "ssn":
        return (1, 0, context, -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1, 0)
    if kind == "secret":
        kinds = sum((any(c.isdigit() for c in s), any(c.islower() for c in s), any(c.isupper() for c in s)))
        mixed = len(set(s)) >= 10 and len(digits) >= 3 and (kinds == 3 or len(s) >= 32)
        return (1 if _ISSUED.match(s) or _SET.search(before) else -1, 1 if _ISSUED.match(s) else 0, context, 1 if mixed else -1, int(len(s) >= 32))
    words = s.split()
    return (1, 1 if any(w.strip(".,'").lower() in GIVEN_NAMES for w in words[1:]) else 0, context, 1 if len(words) == 3 else -1, len(words) - 2)


def _patterns(docs: DataFrame) -> list[tuple[str, int]]:
    """(kind and votes, count) over every candidate and base span of all documents: at most len(KINDS) * 3**4 * 2 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    seen.update(f"{s[0]} {' '.join(map(str, votes(text, s)))}" for s in base + candidates(text, base))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    counted = docs.select("text").mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return sorted((r[0], r[1]) for r in counted.collect())


def reliabilities(patterns: list[tuple[str, int]], rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: (chance of each pattern to be personal data, accuracy by kind and labeler)."""
    kind = np.array([KINDS.index(p.split()[0]) for p, _ in patterns], int)
    vote = np.array([[int(v) for v in p.split()[1 : 1 + len(LABELERS)]] for p, _ in patterns], float).reshape(-1, len(LABELERS))
    n = np.array([c for _, c in patterns], float)
    accuracy = np.full((len(KINDS), len(LABELERS)), 0.8)
    prior = np.full(len(KINDS), 0.5)
    chance = np.zeros(len(n))
    for _ in range(rounds):
        weight = np.log(accuracy / (1 - accuracy))[kind]
        chance = 1 / (1 + np.exp(-np.clip((vote * weight).sum(axis=1) + np.log(prior / (1 - prior))[kind], -30, 30)))
        for k in range(len(KINDS)):
            here = kind == k
            # two virtual spans a labeler keep accuracies and priors off the ends
            prior[k] = (n[here] @ chance[here] + 1) / (n[here].sum() + 2)
            for j in range(len(LABELERS)):
                said = here & (vote[:, j] != 0)
                right = n[said] @ np.where(vote[said, j] > 0, chance[said], 1 - chance[said])
                accuracy[k, j] = np.clip((right + 1.6) / (n[said].sum() + 2), 0.5, 0.99)
    return chance, accuracy


def _features(patterns: list[str]) -> np.ndarray:
    out = np.zeros((len(patterns), len(KINDS) + 2 * len(LABELERS) + 1))
    for i, p in enumerate(patterns):
        k, *v = p.split()
        out[i, KINDS.index(k)] = 1
        for j, x in enumerate(map(int, v[: len(LABELERS)])):
            out[i, len(KINDS) + 2 * j + (x < 0)] = float(x != 0)
        out[i, -1] = int(v[-1])
    return out


def fit(docs: DataFrame) -> np.ndarray:
    """Weights of the span classifier: ridge logistic regression on the chances that EM gives, over the patterns of all documents."""
    patterns = _patterns(docs)
    if not patterns:
        return np.zeros(len(KINDS) + 2 * len(LABELERS) + 1)
    chance, _ = reliabilities(patterns)
    x, n = _features([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    n = n / n.sum() * len(n) ** 0.5 + 1 / len(n)  # rare patterns count too
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - chance)) + 0.01 * w
        hess = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.01 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


def all_spans(text: str, weights: np.ndarray, threshold: float = 0.5) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind, then start: base spans stay, candidates come in if the classifier takes them."""
    base = base_spans(text)
    out, end = list(base), {}
    for s in sorted(candidates(text, base), key=lambda s: (KINDS.index(s[0]), s[1])):
        v = f"{s[0]} {' '.join(map(str, votes(text, s)))}"
        if s[1] >= end.get(s[0], 0) and 1 / (1 + np.exp(-float(_features([v])[0] @ weights))) >= threshold:
            out.append(s)
            end[s[0]] = s[2]
    return base, sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span, or run of overlapping spans, replaced by the name of its first kind in brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts and digest of the base spans, and all spans as kind:start:end in code points.

    Null and empty texts have no spans (digest of the empty string). Repeated rows each come back; columns other than
    the two named are not read; an empty table gives no rows. Two scans: vote patterns of all documents, then spans.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weights = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [all_spans(t or "", weights) for t in b.column(1).to_pylist()]
            counts = [Counter(k for k, _, _ in base) for base, _ in rows]
            digest = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in BASE), pa.array(digest, pa.string()), pa.array([written(s) for _, s in rows], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return docs.mapInArrow(run, _SCHEMA)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span in text_col replaced by its kind; null texts stay null, other columns stay as they are."""
    weights = fit(docs.select(F.col(text_col).cast("string").alias("text")))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t and redacted(t, all_spans(t, weights)[1]) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(at).type) if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
