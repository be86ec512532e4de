"""Personal data by weak supervision.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; these spans always stay.
Wider patterns propose more: of these kinds, and national ids, IBANs, persons, credentials, postal addresses and dates of birth.
Labelers (pattern, checksum, gazetteer, cue, counter-cue, shape, variety) vote on every span, or abstain.
Expectation-maximisation estimates, for each kind, how often each labeler votes which way on personal and on other spans, and how
many are personal; base spans have rates of their own, so they can't speak for the proposals of their kind. Rates start
from, and are held by, stated ones that weigh as much as all spans of the kind. A logistic classifier over votes, kind and the span's own
form and neighbours is then trained on the resulting probabilities and decides which proposals are added.

Spans differ only in kind, votes and a few buckets of form as far as the driver is concerned: at most ``PATTERNS`` distinct
ones, whatever the data. Texts are read once: spans and their patterns go to a shared table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, slices

#: Kinds in the order of results; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "national_id", "iban", "person", "secret", "address", "birth_date")
EMAIL, IP, CARD, PHONE, NATIONAL, IBAN, PERSON, SECRET, ADDRESS, BIRTH = range(10)
YES, NO = 1, 2
LABELERS = ("pattern", "checksum", "gazetteer", "cue", "counter_cue", "shape", "variety")
#: P(abstain, yes, no) of each labeler on personal spans, and on others, before any data.
RATES = {
    "pattern": ((0.55, 0.40, 0.05), (0.85, 0.10, 0.05)),
    "checksum": ((0.45, 0.53, 0.02), (0.45, 0.20, 0.35)),
    "gazetteer": ((0.50, 0.45, 0.05), (0.50, 0.15, 0.35)),
    "cue": ((0.50, 0.49, 0.01), (0.90, 0.08, 0.02)),
    "counter_cue": ((0.97, 0.01, 0.02), (0.70, 0.01, 0.29)),
    "shape": ((0.97, 0.01, 0.02), (0.80, 0.01, 0.19)),
    "variety": ((0.97, 0.01, 0.02), (0.85, 0.01, 0.14)),
}
#: Weight of these rates, as a share of the spans of a kind: the same at every size.
ANCHOR = 1.0
THRESHOLD = 0.5
#: Buckets of form: length (4), character before (4), character after (4).
_FORMS = 64
#: kinds and whether base (2), votes (the last three labelers can only say no, the cue only yes), forms.
PATTERNS = len(KINDS) * 2 * 3**3 * 2**4 * _FORMS

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match starts where a run of digits starts, and takes it whole: the guards only spare vain attempts.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")

_NAME = r"[A-Z][a-zà-öø-ÿ]{1,30}(?:-[A-Z][a-zà-öø-ÿ]{1,30})?"
#: (kind, what the text must hold, pattern); where there is a group, it is the span.
_WIDE = (
    (PHONE, "digit", re.compile(r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])")),
    (NATIONAL, "digit", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
    (IBAN, "digit", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    (IP, "digit", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    (EMAIL, "spelled", re.compile(r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{1,64}\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?|\.)[A-Za-z0-9-]{1,63})+")),
    (PERSON, "titled", re.compile(rf"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20{_NAME}(?:\x20{_NAME})?")),
    (PERSON, "named", re.compile(rf"(?<![A-Za-z])({_NAME}(?:\x20[A-Z]\.)?\x20{_NAME})(?![A-Za-z])")),
    (SECRET, "keyed", re.compile(r"""(?i:(?<![a-z0-9])(?:password|passwd|passwort|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key)["']?\x20?(?:=|:(?!//))\x20?["']?)([^\s"',;<>]{5,255}[^\s"',;<>.!?)\]}])""")),
    (SECRET, "digit", re.compile(r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,80}|AIza[A-Za-z0-9_-]{35})(?![0-9A-Za-z])")),
    (ADDRESS, "digit", re.compile(rf"(?<![0-9A-Za-z.,-])[0-9]{{1,5}}\x20{_NAME}(?:\x20{_NAME})?\x20(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Terrace)\b\.?")),
    (ADDRESS, "digit", re.compile(r"(?<![A-Za-zÀ-ÿ])[A-ZÄÖÜ][a-zäöüß]{2,30}(?:straße|strasse|weg|platz|gasse|allee)\x20[0-9]{1,4}[a-z]?(?![0-9A-Za-z])")),
    (BIRTH, "born", re.compile(r"(?i:\b(?:born(?:\x20on)?|date\x20of\x20birth|birth\x20?date|dob|geboren(?:\x20am)?|née?\x20le|nacid[oa]\x20el))\x20?:?\x20?((?:[0-9]{1,2}[./-]){2}[0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])")),
)
_TITLED = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z]")
_TWO_CAPITALS = re.compile(r"\x20(?<=[^\W\d_]\x20)[A-Z]")


def _gates(text: str) -> set[str]:
    """Which classes of patterns the text can hold a match of: cheap tests before the patterns themselves."""
    out = set()
    if _TWO_CAPITALS.search(text):
        out.add("named")
    if any(w in text for w in ("Mr", "Ms", "Dr", "Prof")) and _TITLED.search(text):
        out.add("titled")
    if any(w in text for w in ("at]", "at)", "at}")):
        out.add("spelled")
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in ("pass", "pwd", "secret", "token", "key")):
            out.add("keyed")
    if _ANY_DIGIT.search(text):
        low = text.lower()
        out.add("digit")
        if any(w in low for w in ("born", "birth", "dob", "geboren", "né", "nacid")):
            out.add("born")
    return out


# Top-level domains, countries of IBANs and common given names.
TLD = frozenset(
    "com net org edu gov mil int io info biz name pro app dev xyz online site tech store cloud blog me tv cc co ai uk de fr es it eu us ca au nl ch at be se no dk fi pl pt cz sk hu ro bg gr ie lu li hr si rs ua ru by lt lv ee is tr il jp cn kr in id my sg th vn ph hk tw nz za ng ke eg ma br mx ar cl pe ve ec uy".split()
)
IBAN_COUNTRIES = frozenset("AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT JO KW KZ LB LI LT LU LV MC MD ME MK MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA XK".split())
GIVEN_NAMES = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Nancy Daniel Lisa Matthew Betty Anthony Margaret Mark Sandra Donald Ashley Steven Kimberly Paul Emily Andrew Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Dorothy George Melissa Edward Deborah Ronald Stephanie Timothy Rebecca Jason Sharon Jeffrey Laura Ryan Cynthia Jacob Kathleen Gary Amy Nicholas Angela Eric Anna Jonathan Emma Stephen Samantha Larry Katherine Justin Christine Scott Helen Brandon Rachel Benjamin Carolyn Samuel Janet Gregory Maria Frank Catherine Alexander Heather Raymond Diane Patrick Olivia Jack Julie Peter Sophia Hans Klaus Jürgen Wolfgang Ursula Monika Petra Sabine Heike Stefan Andreas Matthias Lukas Felix Lena Hannah Pierre Jean Jacques Michel Philippe Nathalie Isabelle Sylvie Camille Chloé Léa Louis Hugo Antoine Carlos José Juan Luis Javier Miguel Antonio Carmen Ana Isabel Pilar Lucía Sofía Pablo Diego Fernando Alejandro Marta Elena Giulia Marco Luca Francesca Paolo Ivan Olga Natasha Dmitri Ahmed Mohammed Fatima Ali Omar Yuki Hiroshi Wei Mei Priya Raj Anita Sofia Julia Marie".split()
)
#: Words that stand for a credential but are none.
_PLACEHOLDERS = frozenset("password passwort changeme secret example test none null true false your_password yourpassword xxxxxx token required string hidden".split())
_CUE_OF = {
    EMAIL: r"e-?mail|mail|contact|reach|write|correo|schreib|écri",
    IP: r"ip|address|host|server|login|client",
    CARD: r"card|visa|mastercard|credit|amex|karte|carte|tarjeta",
    PHONE: r"phone|tel|telephone|call|mobile|fax|dial|cell|whatsapp|teléfono|telefon|handy|téléphone",
    NATIONAL: r"ssn|social security|tax id|national id|taxpayer",
    IBAN: r"iban|account|bank|transfer|konto|compte|cuenta",
    PERSON: r"name is|my name|dear|signed|patient|regards|sincerely|mr|mrs|contact|called|lieber|liebe|cher|chère|señora?",
    SECRET: r"password|passwd|passwort|pwd|secret|token|key|credential|credentials",
    ADDRESS: r"live|lives|living|address|resident|street|ship to|home|adresse|dirección|wohnt",
    BIRTH: r"born|birth|dob|geboren|née?|nacid[oa]",
}
_CUE = {k: re.compile(rf"(?<![^\W_])(?:{w})(?![^\W_])", re.I) for k, w in _CUE_OF.items()}
_COUNTER = re.compile(r"(?:\b(?:version|isbn|issn|order|invoice|item|part|page|figure|chapter|section|build|serial|doi)\b[^\n]{0,12}|[#$€£%v])\s?\Z", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the whole run before it, the domain the whole match after it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start; a match that fails its check is dropped."""
    out = [(EMAIL, a, b) for a, b in emails(text)] if "@" in text else []
    if _ANY_DIGIT.search(text):
        if "." in text:
            out += [(IP, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 40 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((CARD, *m.span()))
        if "+" in text:
            out += [(PHONE, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def proposals(text: str, base: list[tuple[int, int, int]], names: frozenset = GIVEN_NAMES) -> list[tuple[int, int, int]]:
    """Spans of the wider patterns that overlap neither a base span nor an earlier proposal."""
    gates = _gates(text)
    found = []
    for kind, gate, pattern in _WIDE:
        if gate in gates:
            group = 1 if pattern.groups else 0
            for m in pattern.finditer(text):
                a, b = m.span(group)
                if gate != "named" or m[1].split(" ", 1)[0] in names or _CUE[PERSON].search(text[max(0, a - 12) : a]):
                    found.append((a, -b, kind))
    if not found:
        return []
    taken = sorted((a, b) for _, a, b in base)
    out, last, k, reach = [], -1, 0, -1
    for a, b, kind in sorted(found):
        b = -b
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if a >= last and a >= reach:
            out.append((kind, a, b))
            last = b
    return out


def _side(c: str) -> int:
    """The bucket of a neighbouring character: none or white space, letter or digit, mark of quoting or assignment, any other."""
    return 0 if not c or c.isspace() else 1 if c.isalnum() else 2 if c in "\"'`=:_/" else 3


def votes(text: str, kind: int, start: int, end: int, base: bool, names: frozenset = GIVEN_NAMES) -> int:
    """The span's pattern: its kind, two bits each for the labelers' votes, whether it is a base span, and buckets of its form."""
    span, before, after = text[start:end], text[max(0, start - 48) : start], text[end : end + 1]
    digits = _digits(span)
    out = [YES if base else 0] + [0] * (len(LABELERS) - 1)
    counted = digits
    if kind == CARD:
        out[1] = YES if luhn(digits) else NO
    elif kind == IBAN:
        packed = span.replace(" ", "")
        out[1] = YES if int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1 else NO
        out[2] = YES if packed[:2] in IBAN_COUNTRIES else NO
    elif kind == NATIONAL:
        out[1] = NO if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else YES
    elif kind == IP:
        out[0 if ":" in span else 1] = YES
    elif kind == PHONE and not base:
        out[1] = NO if digits[0] in "01" else 0
        out[0] = YES if span[0] == "(" else 0
    elif kind == EMAIL:
        out[2] = YES if re.split(r"[^A-Za-z]+", span.rstrip())[-1].lower() in TLD else NO
    elif kind == PERSON:
        out[0] = YES if _TITLED.match(span) else 0
        out[2] = YES if names & set(span.split()) else 0
    elif kind == SECRET:
        out[0] = YES if re.match(r"AKIA|ASIA|gh[pousr]_|xox|AIza", span) or len(span) >= 16 and digits and len(digits) < len(span) else NO if span.isalpha() else 0
        out[2] = NO if span.lower().strip("*.") in _PLACEHOLDERS or span[0] in "$%{<(" else 0
        counted = span
    elif kind == ADDRESS:
        out[0] = YES
    elif kind == BIRTH:
        parts = sorted(int(x) for x in re.split(r"[./-]", span))
        out[1] = YES if parts[0] >= 1 and parts[0] <= 12 and parts[1] <= 31 and (parts[2] <= 99 or 1900 <= parts[2] <= 2030) else NO
    # A credential's key is part of how it was found, so it is no second witness.
    out[3] = 0 if kind == SECRET and before.rstrip(" \"'")[-1:] in ("=", ":") else YES if _CUE[kind].search(re.split(r"[.!?]\s|\n", before)[-1]) else 0
    out[4] = NO if _COUNTER.search(before) else 0
    out[5] = NO if kind != SECRET and (before[-1:].isalnum() or after.isalnum() or before[-1:] in ("_", "/", "=") or after and after in ("_", "/", "=")) else 0
    out[6] = NO if counted and len(set(counted)) < (5 if kind == SECRET else 2) else 0
    form = sum((end - start) >= n for n in (10, 16, 28)) + 4 * _side(before[-1:]) + 16 * _side(after)
    return kind | sum(v << (4 + 2 * i) for i, v in enumerate(out)) | int(base) << 18 | form << 19


def vote_matrix(patterns: list[int]) -> np.ndarray:
    return np.array([[p >> (4 + 2 * i) & 3 for i in range(len(LABELERS))] for p in patterns]).reshape(-1, len(LABELERS))


def reliabilities(patterns: list[int], counts: list[int], rounds: int = 50) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """({kind, plus 16 for base spans: P(vote) by labeler, class (0 other, 1 personal) and vote}, P(personal) by pattern).

    Expectation-maximisation, for each group of spans on its own. Counts enter as shares of the group, and ``RATES`` (and
    a prior of one half) as ``ANCHOR`` times the group's weight.
    """
    v, c = vote_matrix(patterns), np.array(counts, float)
    group = np.array([(p & 15) | (p >> 18 & 1) << 4 for p in patterns])
    stated = np.array([RATES[name][::-1] for name in LABELERS])
    p, rates = np.zeros(len(patterns)), {}
    for g in np.unique(group).tolist():
        rows = np.flatnonzero(group == g)
        w, own = c[rows] / c[rows].sum(), v[rows]
        cast = own[:, :, None] == np.arange(3)
        rate, prior = stated.copy(), 0.5
        for _ in range(rounds):
            log = np.log(rate)
            score = np.einsum("rlv,lcv->rc", cast, log) + np.log([1 - prior, prior])
            q = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
            for k, weight in ((0, w * (1 - q)), (1, w * q)):
                rate[:, k] = (ANCHOR * stated[:, k] + np.einsum("r,rlv->lv", weight, cast)) / (ANCHOR + weight.sum())
            prior = (ANCHOR * 0.5 + (w * q).sum()) / (ANCHOR + 1)
        p[rows], rates[g] = q, rate
    return rates, p


def features(patterns: list[int]) -> np.ndarray:
    """What the span classifier sees of each pattern: kind, votes, and the buckets of its form."""
    v, x = vote_matrix(patterns), np.array(patterns, np.int64)
    form = x >> 19
    one = lambda values, n: values[:, None] == np.arange(n)
    return np.hstack([np.ones((len(v), 1)), v == YES, v == NO, one(x & 15, len(KINDS)), one(x >> 18 & 1, 2), one(form & 3, 4), one(form >> 2 & 3, 4), one(form >> 4 & 3, 4)]).astype(float)


def train(patterns: list[int], counts: list[int], threshold: float = THRESHOLD, rounds: int = 30) -> list[int]:
    """The patterns that the span classifier accepts: logistic, fitted to the probabilities of all spans, each kind with the same weight."""
    if not patterns:
        return []
    _, p = reliabilities(patterns, counts)
    x, c = features(patterns), np.array(counts, float)
    group = np.array([(y & 15) | (y >> 18 & 1) << 4 for y in patterns])
    weight = np.zeros(len(p))
    for g in np.unique(group):
        weight[group == g] = c[group == g] / c[group == g].sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (weight * np.maximum(q * (1 - q), 0.02))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (weight * (p - q)) - 1e-3 * w)
    q = 1 / (1 + np.exp(-x @ w))
    return sorted(pattern for pattern, y in zip(patterns, q) if y >= threshold)


_SPANS = "array<struct<kind:int,start:int,end:int,pattern:int>>"


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``base`` and ``added`` (arrays of kind number, start, end; code points, end exclusive) for each row of docs.

    A null or empty text has no spans, a very long one is read whole. Repeated rows and null ids are kept, and counted as often as
    they stand; other columns are dropped, whatever their names. An empty table gives an empty one. Of proposals that overlap, the one
    that starts first stays, then the longer one, then the one of the earlier kind. Probabilities of equal spans are equal.
    """
    one = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            base, wide = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                sure = base_spans(text)
                more = proposals(text, sure)
                for out, found, flag in ((base, sure, True), (wide, more, False)):
                    out.append([{"kind": k, "start": a, "end": b, "pattern": votes(text, k, a, b, flag)} for k, a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, one), pa.array(wide, one)], ["id", "base", "wide"])

    rows = pick(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    kind = rows.schema["id"].dataType.simpleString()
    found, _ = materialize(docs.sparkSession, rows.mapInArrow(run, f"id {kind}, base {_SPANS}, wide {_SPANS}"), "spans")
    # At most PATTERNS rows.
    counts = found.select(F.explode(F.concat("base.pattern", "wide.pattern")).alias("p")).groupBy("p").count().orderBy("p").collect()
    accepted = train([r.p for r in counts], [r["count"] for r in counts])
    keep = F.array(*[F.lit(p) for p in accepted]) if accepted else F.array().cast("array<int>")
    plain = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(F.col("id").alias(id_col), plain("base").alias("base"), plain(F.filter("wide", lambda s: F.array_contains(keep, s["pattern"]))).alias("added"))


def listed(column):
    """kind:start:end of an array of spans, by kind and start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(column), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
