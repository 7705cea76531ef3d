"""Personal information in free text: found, and replaced by typed placeholders.

Corpus co-occurrence settles what is protected: one pass over all texts counts how often a term, a context or a written
form goes along with protected entities, and the information left, -log2 P(entity | term), is its disclosure. Terms
that leave no more than THRESHOLD_BITS (streets STREET_BITS; words that are given names only before a family name
RARE_BITS) are protected wherever the shape allows:

* written forms of e-mail addresses, numbers, post boxes and Spanish streets count everywhere if they keep company with
  contexts of their kind; a form that is seen often, but seldom so, needs such a context each time;
* words beside a listed given or family name become names, streets before a town with its postcode become
  streets, places before a postcode become towns;
* contexts of unmistakable telephone and identity numbers settle bare runs of digits, so that a number after
  "ticket" or "seed" stays;
* given names that are ordinary words, too, count alone only in a context that names go along with.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.session import Scratch

THRESHOLD_BITS = 2.0
STREET_BITS = 4.0
RARE_BITS = 7.0
LEAST_SUPPORT = 3  # sightings that a term needs, whatever the size of the corpus
FORM_SUPPORT = 20  # sightings from which on a written form is put to the test
MOST_TERMS = 1_000_000  # learned terms that travel with the tasks; more are joined to the texts
CONTEXT_SHARE = 0.002  # a context counts if at least this share of its kind's sure entities stands in it, so there are at most 500

S = r"[ \t ]"
TOKEN = re.compile(r"[^\W\d_]+(?:[’'\-][^\W\d_]+)*")
BEFORE = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<![\W_][a-z]|\bdr|\bno|ms|mr)[.!?…]+\s+|[!?…\n\r]+")
KEEP = re.compile(r"[\W_]+")

_LABEL = r"[^\W_](?:[\w\-]*[^\W_])?"
_DOT = rf"(?:\.|{S}*[\[({{<]{S}*(?:dot|punto|\.){S}*[\])}}>]{S}*|{S}+(?:dot|punto){S}+)"
_AT = rf"(?:{S}*[@＠]{S}*|{S}*[\[({{<]{S}*(?:at|arroba|@){S}*[\])}}>]{S}*|{S}*(?:&#64;|&commat;){S}*)"
EMAIL = re.compile(
    rf"(?<![\w.+\-])[\w+\-]+(?:(?:\.|{S}*[\[({{]{S}*dot{S}*[\])}}]{S}*|{S}+dot{S}+)[\w+\-]+)*(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[^\W\d_]{{2,}}|{S}+(?:at|arroba){S}+{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[^\W\d_]{{2,}})(?![\w@])",
    re.I,
)
X, Y = r"[ \t \u202f.\-‐‑–−/]", r"(?:[ \t \u202f]?[.\-‐‑–−][ \t \u202f]?|[ \t \u202f])"  # separators within numbers
PHONE = re.compile(
    rf"(?<![\w.+\-#/])(?:(?:\+{S}?|00)\d{{1,3}}(?:{X}?\(?\d{{1,4}}\)?){{2,5}}|(?:1{X}?)?\(\d{{3}}\){S}?\d{{3}}{X}?\d{{4}}|(?:1{X})?\d{{3}}({X})\d{{3}}\1\d{{4}}|\(?0\d{{2,4}}\)?{X}\d{{3,4}}{X}\d{{3,4}}|0\d{{4}}{X}\d{{6}})(?!\w|[\-/]\d|\.\d)"
)
BARE_PHONE = re.compile(r"(?<![\w.+\-#/@])(?:1?[2-9]\d{9}|0\d{9,10})(?!\w|[\-/]\d|\.\d)")
_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve)"
SPOKEN = re.compile(rf"(?<!\w)(?:plus[ ,\-]+)?{_DIGIT_WORD}(?:[ ,\-]+{_DIGIT_WORD}){{6,14}}(?!\w)", re.I)
DIGIT_WORDS = frozenset(_DIGIT_WORD[3:-1].split("|"))
ID = re.compile(rf"(?<![\w.+\-#/])(?:\d{{3}}({Y})\d{{2}}\1\d{{4}}|[A-Z]{Y}?\d{{4}}{Y}?\d{{4}}|[A-Z]{{2}}{Y}?\d\d{Y}?\d\d{Y}?\d\d{Y}?[A-D])(?!\w|[\-/]\d|\.\d)", re.I)
BARE_ID = re.compile(r"(?<![\w.+\-#/@])\d{9}(?!\w|[\-/]\d|\.\d)")

# fixed values: words that end or begin the name of a street, units, titles
_SUFFIX = r"(?:street|st|road|rd|lane|ln|avenue|ave|drive|dr|court|ct|close|cl|way|boulevard|blvd|terrace|ter|square|sq|place|pl|crescent|row|walk|hill)"
_PREFIX = r"(?:calle|avenida|avda|av|c/|paseo|plaza|camino|carretera|rue)"
_JOINT = r"(?:stra(?:ß|ss)e|gasse|weg|platz|allee)"
_UNIT = rf"(?:\d{{1,2}}{S}?[ºª°](?:{S}?[a-z]\b)?|(?:apt|apartment|flat|unit|suite|ste|room|floor|piso|puerta|#|no)\.?{S}*#?{S}*\w+(?:-\w+)?)"
_POSTCODE = r"(?:\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2})"
_NAME = r"[^\W\d_][^\W\d_'’\-]*(?:['’\-][^\W\d_]+)*"
_BOX = rf"(?:p\.?{S}?o\.?{S}?box|post(?:al)?{S}office{S}box|post{S}box|apartado(?:{S}de{S}correos|{S}postal)?|apdo\.?(?:{S}de{S}correos)?){S}*(?:n[º°o]\.?{S}*|#{S}*)?\d+"
HEAD = re.compile(
    rf"(?<![\w\-/.:])(?:(?P<box>{_BOX})|(?P<no>\d{{1,5}}{S}?[a-z]?){S}+(?P<street>{_NAME}(?:{S}+{_NAME})?){S}+{_SUFFIX}\b\.?|{_PREFIX}\.?{S}+(?:de{S}+)?(?P<calle>{_NAME}(?:{S}+(?!n[uú]m){_NAME})?)(?:,{S}*|{S}+)(?:(?:n[º°o]\.?|n[uú]m(?:ero)?\.?|#){S}*)?\d{{1,5}}{S}?[a-z]?(?!\w)|(?P<joint>{_NAME}?){_JOINT}{S}+\d{{1,5}}(?:{S}?[a-z](?!\w))?(?!\w))",
    re.I,
)
STREET_WORDS = frozenset((_SUFFIX[3:-1] + "|" + _PREFIX[3:-1]).split("|")) | {"box", "apartado", "apdo", "c"}
PARTICLES = frozenset(("de", "la", "las", "los", "del", "van", "der", "den", "von", "di", "da", "du"))
TAIL_UNIT = re.compile(rf",?{S}*{_UNIT}(?!\w)", re.I)
TAIL_TOWN = re.compile(rf",?{S}*(?P<town>{_NAME}(?:{S}+{_NAME}){{0,2}}),?{S}+{_POSTCODE}(?!\w)", re.I)
TAIL_CODE_TOWN = re.compile(rf",?{S}*{_POSTCODE}{S}+(?P<town>{_NAME}(?:{S}+{_NAME})?)", re.I)
JOINT = re.compile(rf"{_JOINT}{S}+\d", re.I)
TAIL_CODE = re.compile(rf",?{S}*{_POSTCODE}(?!\w)", re.I)
BARE_TOWN = re.compile(rf",{S}*(?P<town>{_NAME}(?:{S}+{_NAME})?)", re.I)
DIGIT = re.compile(r"\d")
EMAIL_FORM = re.compile(r"[@＠]|[\[({<]\W*(?:at|arroba|dot|punto)|&#64;|&commat;|\b(?:at|arroba|dot|punto)\b", re.I)
FORM_SPACE, FORM_LETTER = re.compile(r"\s+"), re.compile(r"[^\W\d_]")
NUMBER_HINT = re.compile(r"\d\D{0,3}\d\D{0,3}\d\D{0,3}\d\D{0,3}\d")


def context(text: str, at: int, n: int = 2) -> str:
    """The last n words before a place, within its sentence; whole words, however far back they begin."""
    back = 40
    while True:
        found = BEFORE.findall(SENTENCE.split(text[max(0, at - back) : at].lower())[-1])
        if len(found) > n or back >= at:  # the first of more words may be a part of one
            return " ".join(found[-n:])
        back *= 4


def contexts(text: str, at: int) -> list[str]:
    """The context of two words and that of one."""
    two = context(text, at)
    return [two, two.rpartition(" ")[2]] if " " in two else [two] if two else []


def form(kind: str, item: str) -> str:
    """How an item is written: digits as 9, letters as a, words of an e-mail address left out."""
    if kind == "email":
        return "email:" + "".join(x if x in "@＠" else x.lower() for x in EMAIL_FORM.findall(item))
    return f"{kind}:" + FORM_SPACE.sub(" ", FORM_LETTER.sub("a", DIGIT.sub("9", item)))


def may_hold_email(low: str) -> bool:
    return "@" in low or "＠" in low or "dot" in low or "punto" in low or "&#64;" in low or "&commat;" in low or "arroba" in low or "(at)" in low or "[at]" in low or "{at}" in low or "<at>" in low


def may_hold_joint(low: str) -> bool:
    return ("stra" in low or "gasse" in low or "weg" in low or "platz" in low or "allee" in low) and JOINT.search(low) is not None


def squeeze(item: str) -> str:
    return KEEP.sub("", item.lower())


def digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


@dataclass
class Knowledge:
    """What the corpus teaches; bounded by the thresholds of support and share."""

    given: set[str] = field(default_factory=set)
    family: set[str] = field(default_factory=set)
    sure_given: set[str] = field(default_factory=set)  # given names that count without a context
    rare_given: set[str] = field(default_factory=set)  # ordinary words that are given names before a family name
    name_contexts: set[str] = field(default_factory=set)
    phone_contexts: set[str] = field(default_factory=set)
    id_contexts: set[str] = field(default_factory=set)
    email_contexts: set[str] = field(default_factory=set)
    address_contexts: set[str] = field(default_factory=set)
    weak_forms: set[str] = field(default_factory=set)  # written forms that count in a context of their kind only
    spread: DataFrame | None = None  # term, kinds: the learned terms, where they are too many to travel
    streets: set[str] = field(default_factory=set)
    towns: set[str] = field(default_factory=set)

    @cached_property
    def pair_tails(self) -> set[str]:
        """Last words of the family names of several words."""
        return {f.split()[-1] for f in self.family if " " in f}

    def known(self, kind: str, text: str, at: int) -> bool:
        """Does the item at a place stand in a context of its kind?"""
        return not getattr(self, f"{kind}_contexts").isdisjoint(contexts(text, at))

    def protects(self, kind: str, text: str, m: re.Match) -> bool:
        return form(kind, m.group()) not in self.weak_forms or self.known(kind, text, m.start())


def bits(part: float, whole: float) -> float:
    """Information left about an entity once a term is known: -log2 P(entity | term)."""
    return -math.log2(part / whole) if part and whole else math.inf


def lexicon(rows: list[tuple[str, str]]) -> tuple[set[str], set[str]]:
    given = {n.lower() for n, k in rows if k == "given"}
    family = {n.lower() for n, k in rows if k == "family"}
    return given, family


def _tokens(text: str, given: set[str], family: set[str]) -> list[tuple[int, int, str]]:
    """Name tokens with their places; a family name of several words, or with particles before it, is one token."""
    out: list[tuple[int, int, str]] = []
    for m in TOKEN.finditer(text):
        w = m.group().lower().replace("’", "'")
        if out and f"{out[-1][2]} {w}" in family and not text[out[-1][1] : m.start()].strip():
            a = out.pop()
            out.append((a[0], m.end(), f"{a[2]} {w}"))
        elif out and out[-1][2] in PARTICLES and w not in given and w not in family and w not in PARTICLES:
            i = len(out) - 1
            while i and out[i - 1][2] in PARTICLES:
                i -= 1
            whole = " ".join([t[2] for t in out[i:]] + [w])
            after_given = i and (out[i - 1][2] in given or len(out[i - 1][2]) == 1)
            if (whole in family or after_given and m.group()[0].isupper()) and not text[out[-1][1] : m.start()].strip():
                a = out[i]
                del out[i:]
                out.append((a[0], m.end(), whole))
            else:
                out.append((m.start(), m.end(), w))
        else:
            out.append((m.start(), m.end(), w))
    return out


def _gap(text: str, a: tuple, b: tuple) -> str:
    return text[a[1] : b[0]].replace("\t", " ").replace(" ", " ")


def address_form(m: re.Match) -> str:
    """The written form of an address that tells itself what it is; empty for a house number before an English street."""
    return "box" if m["box"] else "calle" if m["calle"] else "joint" if m["joint"] is not None else ""


def head_tail(text: str, m: re.Match, towns: set[str]) -> tuple[int, str | None]:
    """Where an address ends that begins with m, and the town if a postcode proves it."""
    end, proof = m.end(), None
    if u := TAIL_UNIT.match(text, end):
        end = u.end()
    if t := TAIL_TOWN.match(text, end):
        return t.end(), t["town"].lower()
    if c := TAIL_CODE.match(text, end):
        if t := TAIL_CODE_TOWN.match(text, end):
            first, _, both = t["town"].lower().partition(" ")
            if f"{first} {both.strip()}" in towns:
                return t.end(), None
            if first in towns:
                return t.start("town") + len(first), None
        return c.end(), None
    if t := BARE_TOWN.match(text, end):
        words = t["town"].lower().split()
        for n in (2, 1):
            if len(words) >= n and " ".join(words[:n]) in towns:
                if n == len(words):
                    end = t.end()
                else:
                    end = t.start("town") + len(t["town"].split()[0])
                if c := TAIL_CODE.match(text, end):
                    end = c.end()
                break
    return end, proof


def observe(text: str, given: set[str], family: set[str], heads: set[str], seen: Counter) -> None:
    """Adds to seen what one text teaches; heads are the first words of family names of several words."""
    def sighted(kind: str, m: re.Match) -> None:
        cs = contexts(text, m.start())
        for c in cs:
            seen[f"\x01{kind}\x01{c}"] += 1
        seen[f"\x01form\x01{form(kind, m.group())}\x01{cs[0] if cs else ''}"] += 1

    lower = text.lower()
    if may_hold_email(lower):
        for m in EMAIL.finditer(text):
            sighted("email", m)
        text = EMAIL.sub(" . ", text)
        lower = text.lower()
    low = TOKEN.findall(lower.replace("’", "'"))
    seen.update(low)
    if NUMBER_HINT.search(text):
        for pattern, kind in ((PHONE, "phone"), (ID, "id")):
            for m in pattern.finditer(text):
                sighted(kind, m)
        for pattern, kind in ((BARE_PHONE, "bare_phone"), (BARE_ID, "bare_id")):
            for m in pattern.finditer(text):
                for c in contexts(text, m.start()):
                    seen[f"\x01{kind}\x01{c}"] += 1
    if DIGIT.search(text) and (not STREET_WORDS.isdisjoint(low) or may_hold_joint(lower)):
        for m in HEAD.finditer(text):
            street = (m["street"] or m["calle"] or "").lower()
            _, town = head_tail(text, m, set())
            if street:
                seen[f"\x01shape\x01{street}"] += 1
                if town or m["calle"]:
                    seen[f"\x01street\x01{street}"] += 1
            if town and (street or m["box"]):
                seen[f"\x01town\x01{town}"] += 1
            if town or m["calle"] or m["box"] or m["joint"] is not None:
                for c in contexts(text, m.start()):
                    seen[f"\x01address\x01{c}"] += 1
            if kind := address_form(m):
                cs = contexts(text, m.start())
                seen[f"\x01form\x01address:{kind}\x01{cs[0] if cs else ''}"] += 1
    if given.isdisjoint(low) and family.isdisjoint(low) and heads.isdisjoint(low):
        return
    toks = _tokens(text, given, family)
    for t in toks:
        if " " in t[2]:
            seen[t[2]] += 1
    def big(p: int) -> bool:
        last = text[toks[p][0] : toks[p][1]].split()[-1]
        return last[0].isupper() and not last.isupper()

    for i, (a, _, w) in enumerate(toks):
        nxt = toks[i + 1] if i + 1 < len(toks) else None
        if w in given and nxt:
            j = i + 1
            if len(nxt[2]) == 1 and j + 1 < len(toks) and _gap(text, nxt, toks[j + 1]) in (". ", " "):
                j += 1
            if _gap(text, toks[j - 1], toks[j]).strip(". ") == "" and len(toks[j][2]) > 2:
                if big(j):
                    seen[f"\x01family\x01{toks[j][2]}\x01{w}"] += 1
                if toks[j][2] in family:
                    seen[f"\x01full\x01{w}\x01{toks[j][2]}"] += 1
                    seen[f"\x01name\x01{context(text, a)}"] += 1
        elif w in family and i and not (nxt and _gap(text, toks[i], nxt).strip() == "," and nxt[2] in given):
            j = i - 1
            if len(toks[j][2]) == 1 and i > 1 and _gap(text, toks[j], toks[i]) in (". ", " "):
                j -= 1
            if len(toks[j][2]) > 2 and _gap(text, toks[j], toks[j + 1]).strip() == "" and big(j):
                seen[f"\x01given\x01{toks[j][2]}\x01{w}"] += 1
            elif nxt and len(nxt[2]) > 2 and big(i + 1) and nxt[2] not in family and _gap(text, toks[i], nxt) == ", ":
                seen[f"\x01given\x01{nxt[2]}\x01{w}"] += 1


def learn(posts: DataFrame, text: str, names: list[tuple[str, str]]) -> Knowledge:
    """One pass over all texts; counts are summed per term by partial aggregates, and only terms of enough support come back."""
    given, family = lexicon(names)
    heads = {f.split()[0] for f in family if " " in f}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for t in pdf["t"]:
                observe(t, given, family, heads, seen)
            if len(seen) > 500_000:
                yield pd.DataFrame({"k": list(seen), "n": list(seen.values())})
                seen = Counter()
        if seen:
            yield pd.DataFrame({"k": list(seen), "n": list(seen.values())})

    counts = posts.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(run, "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))
    counts = Scratch(posts.sparkSession, "pii").write(counts.where((F.col("n") >= LEAST_SUPPORT) | F.col("k").rlike("^\x01(family|given|full|form)\x01")))
    marked = counts.where(F.col("k").startswith("\x01")).select(F.split("k", "\x01").alias("p"), "n").select(F.col("p")[1].alias("kind"), F.col("p")[2].alias("term"), F.get("p", F.lit(3)).alias("partner"), "n")
    kinds = ("phone", "id", "name", "email", "address")
    total = {r["kind"]: r["n"] for r in marked.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # one row a kind
    k = Knowledge(given=set(given), family=set(family))
    share = F.create_map(*[x for c in kinds for x in (F.lit(c), F.lit(max(LEAST_SUPPORT, CONTEXT_SHARE * total.get(c, 0))))])
    sure = {(r["kind"], r["term"]): r["n"] for r in marked.where(F.col("kind").isin(*kinds)).where((F.col("n") >= share[F.col("kind")]) & (F.col("term") != "")).collect()}  # at most 500 per kind, twice over for one word and two
    k.weak_forms = _weak_forms(marked)
    if k.weak_forms:  # what weak forms alone stood in is no context
        weak = marked.where((F.col("kind") == "form") & F.col("term").isin(*k.weak_forms)).select(F.split("term", ":")[0].alias("of"), "partner", "n")
        for c in (F.col("partner"), F.when(F.col("partner").contains(" "), F.element_at(F.split("partner", " "), -1))):
            for r in weak.select("of", c.alias("c"), "n").where(F.col("c").isin(*{c for _, c in sure})).groupBy("of", "c").agg(F.sum("n").alias("n")).collect():  # as many as sure has, at most
                if (r["of"], r["c"]) in sure:
                    sure[r["of"], r["c"]] -= r["n"]
        sure = {(kind, c): n for (kind, c), n in sure.items() if n >= max(LEAST_SUPPORT, CONTEXT_SHARE * total.get(kind, 0))}
    # a context that goes along with more bare numbers than sure ones tells nothing
    asked = {c for kind, c in sure if kind in ("phone", "id")}
    bare = {(r["kind"], r["term"]): r["n"] for r in marked.where(F.col("kind").isin("bare_phone", "bare_id") & F.col("term").isin(*(asked or {""}))).collect()}
    for kind, c in sure:
        if bits(sure[kind, c], sure[kind, c] + bare.get((f"bare_{kind}", c), 0)) <= THRESHOLD_BITS:
            getattr(k, f"{kind}_contexts").add(c)
    terms = _learned_terms(counts, marked, k)
    if terms.count() > MOST_TERMS:
        k.spread = terms
        return k
    _take_terms(k, [(r["term"], r["kinds"]) for r in terms.collect()])  # at most MOST_TERMS
    return k


GIVEN, FAMILY, SURE, RARE, STREET, TOWN = 1, 2, 4, 8, 16, 32


def _weak_forms(marked: DataFrame) -> set[str]:
    """Written forms seen FORM_SUPPORT times or more that leave more than THRESHOLD_BITS; the patterns allow a few thousand forms.

    A sighting keeps company if other forms of the kind stand in its context, too, CONTEXT_SHARE of all that the kind
    has or more. A kind's most frequent form is what the others are held against.
    """
    kind = F.split("term", ":")[0]
    seen = marked.where("kind = 'form'").select("term", kind.alias("of"), F.col("partner").alias("c"), "n")
    total = seen.groupBy("of").agg(F.sum("n").alias("total"))  # one row a kind
    shared = seen.groupBy("of", "c").agg(F.sum("n").alias("all"))
    met = seen.join(shared, ["of", "c"]).join(F.broadcast(total), "of")
    near = (F.col("c") != "") & (F.col("all") - F.col("n") >= F.greatest(F.lit(LEAST_SUPPORT), F.lit(CONTEXT_SHARE) * F.col("total")))
    forms = met.groupBy("of", "term").agg(F.sum("n").alias("n"), F.sum(F.when(near, F.col("n")).otherwise(0)).alias("near"))
    first = forms.groupBy("of").agg(F.max_by("term", F.struct("n", "term")).alias("term"))
    weak = forms.where((F.col("n") >= FORM_SUPPORT) & (F.col("near") < 2.0**-THRESHOLD_BITS * F.col("n"))).join(F.broadcast(first), "term", "left_anti")
    return {r["term"] for r in weak.select("term").collect()}


def _learned_terms(counts: DataFrame, marked: DataFrame, k: Knowledge) -> DataFrame:
    """term, kinds: the terms whose disclosure is within its threshold, with the kinds they belong to added up."""
    words = counts.where(~F.col("k").startswith("\x01")).select(F.col("k").alias("term"), F.col("n").alias("whole"))
    partners = marked.where("partner is not null and kind in ('family', 'given', 'full')").groupBy("kind", "term").agg(F.sum("n").alias("n"), F.count("partner").alias("partners")).where((F.col("partners") >= 2) & (F.col("n") >= LEAST_SUPPORT))
    told = partners.join(words, "term").select("kind", "term", "n", "whole")
    family = told.where((F.col("kind") == "family") & (F.col("n") >= 2.0**-THRESHOLD_BITS * F.col("whole"))).select("term")
    tied = told.where(F.col("kind").isin("given", "full")).groupBy("term").agg(F.sum("n").alias("n"), F.max("whole").alias("whole")).where(F.col("n") >= 2.0**-RARE_BITS * F.col("whole"))
    tied = tied.where(~F.col("term").isin(*(k.family or {""}))).join(family, "term", "left_anti")
    close = F.col("n") >= 2.0**-THRESHOLD_BITS * F.col("whole")
    given = tied.select("term", F.when(close, GIVEN + SURE).when(F.col("term").isin(*(k.given or {""})), GIVEN).otherwise(RARE).alias("kinds"))
    shapes = marked.where("kind = 'shape'").select("term", F.col("n").alias("whole"))
    streets = marked.where("kind = 'street'").select("term", "n").join(shapes, "term").where(F.col("n") >= 2.0**-STREET_BITS * F.col("whole")).select("term", F.lit(STREET).alias("kinds"))
    towns = marked.where("kind = 'town'").where(F.col("n") >= LEAST_SUPPORT).select("term", F.lit(TOWN).alias("kinds"))
    every = family.select("term", F.lit(FAMILY).alias("kinds")).unionByName(given).unionByName(streets).unionByName(towns)
    return Scratch(counts.sparkSession, "terms").write(every.groupBy("term").agg(F.sum("kinds").alias("kinds")))


def _take_terms(k: Knowledge, terms: list[tuple[str, int]]) -> None:
    for term, kinds in terms:
        for bit, name in ((GIVEN, "given"), (FAMILY, "family"), (SURE, "sure_given"), (RARE, "rare_given"), (STREET, "streets"), (TOWN, "towns")):
            if kinds & bit:
                getattr(k, name).add(term)


def keys(text: str) -> set[str]:
    """Every term of the text that may be looked up: runs of one to four words."""
    w = TOKEN.findall(text.lower().replace("’", "'"))
    return {" ".join(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1)}


def spans(text: str, k: Knowledge) -> list[tuple[int, int, str]]:
    """Personal items of a text as (begin, end, kind), in order, none overlapping another."""
    taken: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in taken)

    def add(a: int, b: int, kind: str) -> None:
        if free(a, b):
            taken.append((a, b, kind))

    lower = text.lower()
    low = TOKEN.findall(lower.replace("’", "'"))
    kinds = set(low)
    if may_hold_email(lower):
        for m in EMAIL.finditer(text):
            if k.protects("email", text, m):
                add(m.start(), m.end(), "email")
    if DIGIT.search(text):
        if not STREET_WORDS.isdisjoint(kinds) or may_hold_joint(lower):
            for m in HEAD.finditer(text):
                street = (m["street"] or m["calle"] or "").lower()
                kind = address_form(m)
                if street in k.streets or kind and (f"address:{kind}" not in k.weak_forms or k.known("address", text, m.start())):
                    add(m.start(), head_tail(text, m, k.towns)[0], "address")
        if NUMBER_HINT.search(text):
            for m in ID.finditer(text):
                if k.protects("id", text, m):
                    add(m.start(), m.end(), "id_number")
            for m in PHONE.finditer(text):
                g = m.group()
                if 9 <= digits(g) <= 15 and k.protects("phone", text, m):
                    add(m.start(), m.end() - (g.endswith(")") and g.count(")") > g.count("(")), "phone")
            for m in BARE_PHONE.finditer(text):
                if k.known("phone", text, m.start()):
                    add(m.start(), m.end(), "phone")
            for m in BARE_ID.finditer(text):
                if k.known("id", text, m.start()):
                    add(m.start(), m.end(), "id_number")
    if len(DIGIT_WORDS & kinds) > 2:
        for m in SPOKEN.finditer(text):
            add(m.start(), m.end(), "phone")
    if k.given.isdisjoint(kinds) and k.family.isdisjoint(kinds) and k.pair_tails.isdisjoint(kinds) and k.rare_given.isdisjoint(kinds):
        return sorted(taken)
    toks = _tokens(text, k.given, k.family)
    i, n = 0, len(toks)
    blank = lambda p, q: _gap(text, toks[p], toks[q]).strip(" ") == "" and _gap(text, toks[p], toks[q]) != ""
    after = lambda p, q: _gap(text, toks[p], toks[q]).strip(" ") in ("", ".") and _gap(text, toks[p], toks[q]) != ""
    comma = lambda p, q: _gap(text, toks[p], toks[q]).strip(" ") == "," and "\n" not in _gap(text, toks[p], toks[q])
    one = lambda p: p < n and len(toks[p][2]) == 1
    giv = lambda p: p < n and toks[p][2] in k.given
    fam = lambda p: p < n and toks[p][2] in k.family
    while i < n:
        end = None
        if giv(i) or one(i) or toks[i][2] in k.rare_given:
            j = i + 1
            while one(j) and (blank(j - 1, j) or (one(j - 1) and after(j - 1, j))) and j + 1 < n and after(j, j + 1):
                j += 1
            ok = fam(j) and (blank(j - 1, j) or (one(j - 1) and after(j - 1, j)))
            if ok:
                end = j
        if end is None and fam(i):
            if i + 1 < n and (comma(i, i + 1) or blank(i, i + 1)) and (giv(i + 1) or (toks[i + 1][2] in k.rare_given and (text[toks[i + 1][0]].isupper() or context(text, toks[i][0]) in k.name_contexts)) or (one(i + 1) and comma(i, i + 1) and text[toks[i + 1][1] : toks[i + 1][1] + 1] == ".")):
                end = i + 1
                while one(end + 1) and blank(end, end + 1) and text[toks[end + 1][1] : toks[end + 1][1] + 1] == ".":
                    end += 1
        if end is None and giv(i) and (toks[i][2] in k.sure_given and toks[i][2] not in k.family or context(text, toks[i][0]) in k.name_contexts):
            end = i
        if end is None and toks[i][2] in k.rare_given and text[toks[i][0]].isupper() and context(text, toks[i][0]) in k.name_contexts:
            end = i
        if end is not None:
            add(toks[i][0], toks[end][1], "name")
            i = end + 1
        else:
            i += 1
    return sorted(taken)


def _per_text(posts: DataFrame, id_col: str, text: str, k: Knowledge, out: Callable[[object, str, list[tuple[int, int, str]]], list[tuple]], columns: list[str], schema: str) -> DataFrame:
    """Rows of out(id, text, spans) for every text; where the learned terms are too many to travel, each text gets those of its own words by a join."""
    spark, spread = posts.sparkSession, k.spread
    k.spread = None
    shared = spark.sparkContext.broadcast(k)
    k.spread = spread
    rows = posts.select(F.col(id_col).alias("i"), F.col(text).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = shared.value
        for pdf in batches:
            found = []
            for i, t, *own in pdf.itertuples(index=False):
                know = base
                if own:
                    know = replace(base, given=set(base.given), family=set(base.family), sure_given=set(), rare_given=set(), streets=set(), towns=set())
                    _take_terms(know, [(e["term"], e["kinds"]) for e in own[0]] if own[0] is not None else [])
                found += out(i, t, spans(t, know) if isinstance(t, str) else [])
            yield pd.DataFrame({c: pd.Series(v, dtype="int64" if c == "i" and None not in v else object) for c, v in zip(columns, zip(*found))} if found else {c: pd.Series([], dtype="int64" if c == "i" else object) for c in columns})

    if spread is None:
        return rows.mapInPandas(run, schema)
    kept = Scratch(spark, "texts").write(rows.withColumn("r", F.monotonically_increasing_id()))

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [(r, w) for r, t in zip(pdf["r"], pdf["t"]) for w in keys(t)]
            yield pd.DataFrame({"r": pd.Series([r for r, _ in pairs], dtype="int64"), "term": pd.Series([w for _, w in pairs], dtype=object)})

    met = kept.where("t is not null").select("r", "t").mapInPandas(named, "r long, term string").join(spread, "term").groupBy("r").agg(F.collect_list(F.struct("term", "kinds")).alias("own"))
    return kept.join(met, "r", "left").select("i", "t", "own").mapInPandas(run, schema)


def find_items(posts: DataFrame, id_col: str, text: str, k: Knowledge) -> DataFrame:
    """id_col, kind, item: the distinct personal items of each row, squeezed to lower-case letters and digits.

    Null, empty and blank texts have none; a repeated id gives the items of all its rows once.
    """
    out = lambda i, t, found: [(i, kind, squeeze(t[a:b])) for a, b, kind in found]
    return _per_text(posts.where(F.col(text).isNotNull()), id_col, text, k, out, ["i", "kind", "item"], "i long, kind string, item string").distinct().withColumnRenamed("i", id_col)


def sanitise(posts: DataFrame, id_col: str, text: str, k: Knowledge) -> DataFrame:
    """id_col, sanitised: every row's text with each item replaced by <EMAIL>, <PHONE>, <ID_NUMBER>, <ADDRESS> or <NAME>, all else unchanged; null stays null."""
    def out(i: object, t: str, found: list[tuple[int, int, str]]) -> list[tuple]:
        for a, b, kind in reversed(found):
            t = f"{t[:a]}<{kind.upper()}>{t[b:]}"
        return [(i, t)]

    return _per_text(posts, id_col, text, k, out, ["i", "s"], "i long, s string").toDF(id_col, "sanitised")
