"""Personal data: fixed patterns, and further spans by weak supervision.

Candidates that the fixed patterns miss are voted on by labelers: shapes, gazetteers and context. Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is, and a logistic classifier of the spans is
trained on the resulting probabilities. Both see counts of patterns only, whose number doesn't grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lumora.llm.shared import before_each, id_and_text, joined_spans, let, of_kind, pattern_spans


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits has a right check digit."""
    places = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = 2 * d - F.when(d > 4, 9).otherwise(0)
        return F.when((F.length(digits) - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda n, x: n + x) % 10 == 0


class Base(NamedTuple):
    kind: str
    pattern: str
    hints: tuple[str, ...]
    keep: Callable[[Column], Column] | None


def _between(least: int, most: int) -> Callable[[Column], Column]:
    return lambda m: F.length(_digits(m)).between(least, most)


#: The base kinds in their order. A match may begin at the start of a run or right after the match
#: before, and runs are never given back, so that long runs cost linear time; the matches are those of the plain patterns.
BASE: tuple[Base, ...] = (
    Base("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",), None),
    Base("ip", r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", (), lambda m: m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")),
    Base("card", r"[0-9](?:[\x20-]?[0-9]){15,}+", (), lambda m: _between(16, 19)(m) & luhn(_digits(m))),
    Base("phone", r"\+[0-9][\x20().0-9-]+[0-9]", ("+",), _between(8, 15)),
)


class Candidate(NamedTuple):
    kind: str
    pattern: str
    hints: tuple[str, ...]


_END = r"(?![0-9]|[.-][0-9])"
#: Shapes of one number, tried in this order, so that numbers side by side are told apart; the last takes whole groups of
#: digits up to 19 digits, and what follows is the next number. Runs are never given back, or are short.
NUMBERS: tuple[str, ...] = (
    rf"(?:1[\x20.-])?[(]?[0-9]{{3}}[)]?[\x20.-]?[0-9]{{3}}[\x20.-][0-9]{{4}}{_END}",
    rf"[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}",
    rf"(?:19|20)[0-9]{{2}}[.-][0-9]{{1,2}}[.-][0-9]{{1,2}}{_END}",
    rf"[0-9]{{1,2}}[.-][0-9]{{1,2}}[.-](?:19|20)[0-9]{{2}}{_END}",
    rf"(?:19|20)[0-9]{{2}}\x20?-\x20?(?:19|20)[0-9]{{2}}{_END}",
    rf"0[1-9](?:[\x20.-][0-9]{{2}}){{4}}{_END}",
    # ahead of another number that begins with 0, of one of three groups, of one without separators
    r"[(]?0[0-9]{1,4}[)]?(?:[\x20-]{1,3}[0-9]{2,12}){1,6}?(?=\x20{1,3}[(]?0[0-9]{1,4}[)]?[\x20-]{1,3}[0-9]{3})",
    r"[0-9]{1,12}+(?:[.-][0-9]{1,12}+){1,6}+(?=\x20{1,3}[0-9]{1,12}(?:[.-][0-9]{1,12}){2})",
    r"[0-9]{7,19}+(?=\x20{1,3}[0-9]{6,19}(?![0-9]))",
    r"[(]?[0-9](?:[().\x20-]*+[0-9]){5,18}(?![0-9])",
)


_WORD = r"\p{Lu}[\p{L}'’-]*+"
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Terrace|Way"
#: Number and street as English, German, French and Spanish put them.
ADDRESSES: tuple[str, ...] = (
    rf"(?<![\p{{L}}\p{{N}}])[0-9]{{1,5}}[A-Za-z]?\x20(?:{_WORD}\x20){{1,4}}?(?:{_STREETS})(?![\p{{L}}])",
    r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}-]{0,40}(?:straße|strasse|str\.|weg|platz|allee|gasse)\x20[0-9]{1,4}[a-z]?(?![\p{L}\p{N}])",
    rf"(?<![\p{{L}}\p{{N}}])[0-9]{{1,4}}(?:\x20(?:bis|ter))?,?\x20(?:rue|avenue|boulevard|place|chemin|impasse|allée|quai)\x20(?:(?:de|du|des|la|le|les)\x20|[dl]['’]){{0,3}}{_WORD}(?:\x20{_WORD}){{0,4}}",
    rf"(?<![\p{{L}}\p{{N}}])(?:[Cc]alle|[Aa]venida|Avda\.|[Pp]laza|[Pp]aseo)\x20(?:(?:de|del|la|las|los|el)\x20){{0,3}}{_WORD}(?:\x20{_WORD}){{0,4}},?\x20(?:n[ºo°]\.?\x20?)?[0-9]{{1,4}}(?![\p{{L}}\p{{N}}])",
)
#: Letters and digits of an international account number, alone or in groups of four, or of a passport.
_CODE = r"(?=[A-Z])(?<![\p{L}\p{N}])(?:[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?|[A-Z]{1,2}[0-9]{6,9})(?![\p{L}\p{N}])"
#: Capitalised words in a row, with particles between them; words that announce a name are not part of it.
_NAME = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}_@#/.'’-])(?!(?:Mr|Mrs|Ms|Dr|Prof|Herrn?|Frau|Monsieur|Madame|Mme|Señora?|Sra?|Dear|Name|Named|Signed|Address|Born|My|Mein|Meine|Ich|Je|Me|Mi)(?![\p{{L}}])){_WORD}(?:\x20(?:(?:van|von|de|der|den|del|della|di|da|du|la|le|bin|y)\x20){{0,2}}{_WORD})*+"

#: The gazetteers: short lists of common names and of large places, in lower case. A name or place that is in none can
#: still be found by its context.
GIVEN_NAMES = tuple("""james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark steven paul andrew joshua kevin brian george edward ronald timothy jason
mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra ashley emily donna michelle carol amanda melissa deborah stephanie rebecca laura helen anna alice emma olivia sophia
hans peter klaus jürgen wolfgang dieter stefan andreas uwe bernd jens lukas felix jonas maximilian ursula monika petra sabine renate helga birgit claudia katrin heike lena hannah
jean pierre michel philippe alain jacques nicolas christophe laurent julien antoine françois louis marie nathalie isabelle sylvie catherine françoise céline camille chloé juliette
josé antonio juan manuel francisco luis javier carlos miguel ángel pedro jorge fernando alejandro diego maría carmen ana isabel dolores pilar teresa rosa lucía elena
mohammed ahmed ali omar fatima aisha wei li ming yuki hiroshi priya raj anil giovanni marco giulia ivan olga dmitri""".split())
FAMILY_NAMES = tuple("""smith johnson williams brown jones miller davis wilson anderson taylor thomas moore jackson martin lee thompson white harris clark lewis robinson walker young allen king wright scott hill green adams baker nelson carter mitchell roberts turner phillips campbell parker evans edwards collins
müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann schäfer koch bauer richter klein wolf schröder neumann schwarz zimmermann braun krüger hofmann hartmann lange
bernard dubois durand leroy moreau laurent lefebvre bertrand roux fournier girard bonnet dupont lambert fontaine rousseau vincent mercier
garcía garcia rodríguez gonzález fernández lópez martínez sánchez pérez gómez ruiz hernández díaz moreno álvarez muñoz romero torres navarro ramos
rossi ferrari ivanov petrov kumar singh patel sharma khan nguyen kim chen wang zhang tanaka suzuki silva santos""".split())
PLACES = tuple("""london|manchester|birmingham|liverpool|edinburgh|glasgow|dublin|new york|los angeles|chicago|houston|san francisco|boston|seattle|philadelphia|toronto|sydney|melbourne
berlin|hamburg|münchen|munich|köln|cologne|frankfurt|stuttgart|düsseldorf|leipzig|dresden|wien|vienna|zürich|zurich|bern|basel|paris|marseille|lyon|toulouse|nantes|strasbourg|bordeaux|lille|genève|bruxelles|brussels
madrid|barcelona|valencia|sevilla|zaragoza|málaga|bilbao|buenos aires|bogotá|santiago de chile|ciudad de méxico|rome|milan|lisbon|amsterdam|warsaw|prague|moscow|tokyo|beijing|shanghai|mumbai|delhi|singapore|cairo""".replace("\n", "|").split("|"))
#: Directly before a name or place.
NAMING_WORDS = r"mr\.?|mrs\.?|ms\.?|dr\.?|prof\.?|herr|herrn|frau|monsieur|madame|mme|señor|señora|sr\.|sra\.|my name is|named|name:|signed|dear|mein name ist|ich heiße|je m['’]appelle|me llamo|mi nombre es"
LIVING_WORDS = "lives in|living in|resident of|born in|moved to|address:|wohnt in|wohnhaft in|geboren in|habite à|né à|née à|vive en|nacido en|nacida en|residente en"
#: Within a run of capitalised words: not a person.
THING_WORDS = tuple("the of and license licence university institute company inc ltd gmbh corporation foundation association committee act law public version general software street department ministry january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split())

#: What the labelers vote on; of `name`s, listed places become `place`s, a kind of their own.
CANDIDATES: tuple[Candidate, ...] = (
    Candidate("number", rf"(?=[(0-9])(?<![0-9.+])(?:{'|'.join(NUMBERS)})", ()),
    Candidate("handle", r"(?<![A-Za-z0-9._%+-])@[A-Za-z0-9_]{3,}+(?!\.[\p{L}\p{N}_])", ("@",)),
    Candidate("spelled_email", r"[A-Za-z0-9._-]{2,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{2,64}(?:\x20?[(\[]dot[)\]]\x20?|\.)[A-Za-z]{2,10}", ("(at)", "[at]")),
    Candidate("address", "|".join(ADDRESSES), ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9")),
    Candidate("code", _CODE, ()),
    Candidate("name", _NAME, ()),
)
WORDY = ("address", "name", "place")
CONTEXT = (40, 12)
CONTACT_WORDS = "phone|telephone|tel|mobile|cell|call|fax|whatsapp|telefon|handy|anruf|téléphone|portable|teléfono|móvil|llame|contact|kontakt|contacto|reach|email|mail|follow"
IDENTITY_WORDS = "ssn|passport|iban|account|konto|compte|cuenta|insurance|licence|license|patient|born|birth|ausweis|dni|nif|steuer|sécu|identity|customer"
OTHER_WORDS = "isbn|issn|doi|version|page|pages|chapter|figure|fig|table|section|order|invoice|price|total|sum|article|paragraph|seite|siehe"

ABSTAIN = 2
#: About so many documents, chosen by hash, are enough to fit labelers and classifier; spans are found in all documents.
TRAINING_ROWS = 20_000


def _said(words: str, text: Column) -> Column:
    return F.lower(text).rlike(rf"(?:^|[^\p{{L}}])(?:{words})(?:[^\p{{L}}]|$)")


def _right_before(words: str, text: Column) -> Column:
    return F.lower(text).rlike(rf"(?:^|[^\p{{L}}])(?:{words})\s*$")


def _words(match: Column) -> Column:
    return F.split(F.lower(match), " ")


def votes(c: Column) -> dict[str, Column]:
    """1: private, 0: not, 2: no opinion. `c` has kind, match, before, after."""
    number, match, digits = c["kind"] == "number", c["match"], _digits(c["match"])
    name, wordy, words = c["kind"] == "name", c["kind"].isin(*WORDY), _words(c["match"])
    given = name & (F.size(words) > 1) & F.exists(words, lambda w: w.isin(*GIVEN_NAMES))
    family = name & (F.size(words) > 1) & F.element_at(words, -1).isin(*FAMILY_NAMES)
    yes = lambda test: F.when(test, 1).otherwise(ABSTAIN)
    no = lambda test: F.when(test, 0).otherwise(ABSTAIN)
    return {
        "phone_shape": yes(number & match.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^0[0-9]{1,4}[ -][0-9][0-9 -]{4,}[0-9]$")),
        "identity_shape": yes(number & match.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        "address_shape": yes(c["kind"] == "spelled_email"),
        "contact_words": yes(~wordy & _said(CONTACT_WORDS, c["before"])),
        "code_shape": yes((c["kind"] == "code") & match.rlike("^[A-Z]{2}[0-9]{2}.{10}")),
        "identity_words": yes((number | (c["kind"] == "code")) & _said(IDENTITY_WORDS, c["before"])),
        "other_words": no(~wordy & (_said(OTHER_WORDS, c["before"]) | F.substring(c["before"], -2, 2).rlike(r"[$€£#]"))),
        "measure": no(number & c["after"].rlike(r"^\s?(?:%|€|\$|kg|km|cm|mm|px|mb|gb)")),
        "date_shape": no(number & match.rlike(r"^(?:(?:19|20)[0-9]{2}[-. ][0-9]{1,2}[-. ][0-9]{1,2}|[0-9]{1,2}[-. ][0-9]{1,2}[-. ](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2} ?- ?(?:19|20)[0-9]{2})$")),
        "no_check_digit": no(number & (F.length(digits) >= 13) & ~luhn(digits)),
        "loose_digits": no(number & ((F.length(digits) < 7) | (F.length(F.regexp_replace(match, "[0-9]", "")) >= F.length(digits)))),
        "street_shape": yes(c["kind"] == "address"),
        "given_names": yes(given),
        "family_names": yes(family),
        "places": no((c["kind"] == "place") & ~_right_before(LIVING_WORDS, c["before"])),
        "naming_words": yes(name & _right_before(NAMING_WORDS, c["before"])),
        "living_words": yes(wordy & _right_before(LIVING_WORDS, c["before"])),
        "unlisted": no(name & ~given & ~family & ~_right_before(NAMING_WORDS, c["before"])),
        "thing_words": no(name & F.arrays_overlap(words, F.array(*map(F.lit, THING_WORDS)))),
        "repeated": no(name & (F.size(words) > 2) & (F.size(F.array_distinct(words)) * 2 <= F.size(words))),
    }


#: Votes on words; the others are votes on numbers, handles and spelled addresses. Neither kind sees the other's spans.
WORD_VOTES = ("street_shape", "given_names", "family_names", "places", "naming_words", "living_words", "unlisted", "thing_words", "repeated")


def features(c: Column) -> dict[str, Column]:
    """0 or 1 each."""
    opinions = votes(c)
    number, match, digits = c["kind"] == "number", c["match"], F.length(_digits(c["match"]))
    wordy = c["kind"].isin(*WORDY)
    tests = {
        "handle": c["kind"] == "handle", "spelled": c["kind"] == "spelled_email", "short": number & (digits < 9), "ten": number & digits.between(9, 11), "long": number & (digits > 11),
        "brackets": ~wordy & match.contains("("), "hyphens": number & match.contains("-"), "dots": number & match.contains("."), "spaces": number & match.contains(" "),
        "contact": ~wordy & _said(CONTACT_WORDS, c["before"]), "identity": ~wordy & _said(IDENTITY_WORDS, c["before"]), "other": ~wordy & _said(OTHER_WORDS, c["before"]), "century": number & match.rlike("^(?:19|20)"),
        "phone_like": opinions["phone_shape"] == 1, "identity_like": opinions["identity_shape"] == 1, "unchecked": opinions["no_check_digit"] == 0,
        "code": c["kind"] == "code", "account": opinions["code_shape"] == 1, "name": c["kind"] == "name", "place": c["kind"] == "place", "address": c["kind"] == "address", "given": opinions["given_names"] == 1, "family": opinions["family_names"] == 1,
        "named": opinions["naming_words"] == 1, "lives": opinions["living_words"] == 1, "unlisted": opinions["unlisted"] == 0, "thing": opinions["thing_words"] == 0, "repeated": opinions["repeated"] == 0,
    }
    return {name: test.cast("int") for name, test in tests.items()}


def base_spans(text: Column) -> Column:
    """Array of (kind, rank, start, end) of the fixed patterns."""
    parts = []
    for rank, rule in enumerate(BASE):
        spans = pattern_spans(text, rule.pattern, *rule.hints)
        parts.append(of_kind(_kept(spans, rule.keep) if rule.keep else spans, rule.kind, rank))
    return F.concat(*parts)


def _kept(spans: Column, keep: Callable[[Column], Column]) -> Column:
    return F.filter(spans, lambda s: keep(s["match"]))


def candidates(text: Column, base: Column) -> Column:
    """Array of (kind, rank, start, end, match, before, after) that overlap no base span."""

    def named(spans: Column, kind: str, rank: int) -> Column:
        made = F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), s["before"].alias("before"), s["after"].alias("after")))
        return F.coalesce(made, F.array().cast("array<struct<kind:string,rank:int,start:int,end:int,match:string,before:string,after:string>>"))

    every = F.concat(*[named(pattern_spans(text, c.pattern, *c.hints, context=CONTEXT), c.kind, len(BASE) + k) for k, c in enumerate(CANDIDATES)])

    def placed(c: Column) -> Column:
        listed = (c["kind"] == "name") & F.lower(c["match"]).isin(*PLACES)
        return c.withField("kind", F.when(listed, "place").otherwise(c["kind"])).withField("rank", c["rank"] + listed.cast("int"))

    def sensible(c: Column) -> Column:
        named_so = _right_before(NAMING_WORDS, c["before"])
        return F.when(c["kind"] == "number", F.length(_digits(c["match"])).between(6, 19)).when(c["kind"] == "name", c["match"].contains(" ") | named_so).otherwise(True)

    free = F.filter(F.transform(every, placed), sensible)
    return let(free, lambda c: F.when((F.size(c) == 0) | (F.size(base) == 0), c).otherwise(let(_edges(base, c), lambda e: _apart(c, e))))


FAR = 2**31 - 1


def _edges(base: Column, found: Column) -> Column:
    """Starts and ends of base spans, and starts and numbers of candidates, in one order; a base span comes first at a tie."""
    own = F.transform(found, lambda c, i: F.struct(c["start"].alias("start"), F.lit(1).alias("own"), F.lit(0).alias("end"), i.alias("number")))
    return F.sort_array(F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("own"), b["end"].alias("end"), F.lit(-1).alias("number"))), own))


def _apart(found: Column, edges: Column) -> Column:
    """The candidates that no base span overlaps: none that starts earlier ends behind their start, none starts inside."""
    ends = before_each(F.transform(edges, lambda e: e["end"]), F.greatest, F.lit(0))
    starts = F.reverse(before_each(F.reverse(F.transform(edges, lambda e: F.when(e["own"] == 0, e["start"]).otherwise(FAR))), F.least, F.lit(FAR)))

    def of(end: Column, start: Column) -> Column:
        own = F.filter(F.transform(edges, lambda e, k: F.struct(e["number"].alias("number"), e["start"].alias("start"), end[k].alias("end"), start[k].alias("next"))), lambda x: x["number"] >= 0)
        free = F.filter(own, lambda x: (x["end"] <= x["start"]) & (x["next"] >= found[x["number"]]["end"]))
        return F.transform(free, lambda x: found[x["number"]])

    return let(ends, lambda end: let(starts, lambda start: of(end, start)))


class Model(NamedTuple):
    """Weights of the span classifier, and how often each labeler votes rightly when it votes on a class."""

    intercept: float
    weights: dict[str, float]
    reliability: dict[str, float]


def reliabilities(table: np.ndarray, counts: np.ndarray, rounds: int = 200, strength: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: (labeler, class, outcome) rates, and each pattern's probability to be private.

    `table` has a row per pattern and a column per labeler; the outcomes are votes for, against, and abstention. The
    start is the majority of votes. Pseudo-counts of `strength` spans per class, in which labelers vote rightly ten times as
    often as wrongly, keep rates of rare votes sensible.
    """
    expected = np.array([[0.30, 0.03, 0.67], [0.03, 0.30, 0.67]])  # outcomes 0, 1, none; for class 0 and class 1
    outcomes = np.stack([table == 0, table == 1, table == ABSTAIN], axis=2).astype(float)
    balance = (table == 1).sum(axis=1) - (table == 0).sum(axis=1)
    probability = np.where(balance > 0, 0.9, np.where(balance < 0, 0.05, 0.1))
    rates = np.zeros((table.shape[1], 2, 3))
    for _ in range(rounds):
        weights = np.stack([(1 - probability) * counts, probability * counts])
        share = (weights.sum(axis=1) + 1) / (weights.sum() + 2)
        seen = np.einsum("cp,plo->lco", weights, outcomes)
        rates = (seen + strength * expected[None]) / (seen.sum(axis=2, keepdims=True) + strength)
        score = np.log(share[:, None]) + np.einsum("plo,lco->cp", outcomes, np.log(rates))
        latest = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
        if np.abs(latest - probability).max(initial=0) < 1e-9:
            break
        probability = latest
    return rates, probability


def logistic(x: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights (the intercept first) of a logistic regression on soft targets, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (p - target)) + ridge * w
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sample(docs: DataFrame, most: int) -> DataFrame:
    """Of (doc_id, text) about `most` rows, those of the least hashes; all rows of a smaller table."""
    n = docs.count()
    return docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) < most) if n > most else docs


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAINING_ROWS) -> Model:
    """Labelers' reliabilities and the span classifier, from all candidates of about `most` documents, chosen by hash.

    Votes and features are small whole numbers, so their patterns are counted with partial sums, and only
    these counts, in practice some hundred, reach the driver. Expectation-maximisation runs over votes on words and over the
    other votes, as far more words than numbers are candidates. Without candidates the classifier finds nothing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = sample(id_and_text(docs, id_col, text_col), most).select(F.explode_outer(let(base_spans(text), lambda base: candidates(text, base))).alias("c")).where("c IS NOT NULL")
    v, f = votes(F.col("c")), features(F.col("c"))
    rows = found.select(*[c.alias(f"v_{n}") for n, c in v.items()], *[c.alias(f"f_{n}") for n, c in f.items()]).groupBy(*[f"v_{n}" for n in v], *[f"f_{n}" for n in f]).agg(F.count(F.lit(1)).alias("n")).collect()
    if not rows:
        return Model(-1.0, dict.fromkeys(f, 0.0), dict.fromkeys(v, 0.8))
    rows.sort(key=tuple)
    x = np.array([[r[f"f_{n}"] for n in f] for r in rows], dtype=float)
    counts = np.array([r["n"] for r in rows], dtype=float)
    wordy = np.array([any(r[f"f_{kind}"] for kind in WORDY) for r in rows])
    probability, right = np.zeros(len(rows)), {}
    for names, own in (([n for n in v if n not in WORD_VOTES], ~wordy), (list(WORD_VOTES), wordy)):
        table = np.array([[r[f"v_{n}"] for n in names] for r, there in zip(rows, own) if there]).reshape(-1, len(names))
        rates, probability[own] = reliabilities(table, counts[own])
        right |= dict(zip(names, map(float, (rates[:, 0, 0] + rates[:, 1, 1]) / rates[:, :, :2].sum(axis=(1, 2)))))
    w = logistic(x, probability, counts)
    return Model(float(w[0]), dict(zip(f, map(float, w[1:]))), right)


def find_private(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per input row: doc_id and all spans (kind, rank, start, end) in code points, base kinds first.

    A candidate is added where the classifier's probability is over `least`, not where it equals it. Null texts count as empty.
    Repeated rows and null ids give a row each, empty tables none; texts of any length are scanned whole; other columns are
    not read. The model is trained on a bounded sample of the same documents if none is given.
    """
    model = model or train(docs, id_col, text_col)
    return id_and_text(docs, id_col, text_col).select("doc_id", find_spans(F.col("text"), model, least).alias("spans"))


def find_spans(text: Column, model: Model, least: float = 0.5) -> Column:
    """Array of all spans of a text."""
    text = F.coalesce(text, F.lit(""))

    def private(c: Column) -> Column:
        score = F.lit(model.intercept)
        for name, feature in features(c).items():
            score = score + F.lit(model.weights[name]) * feature
        return score > F.lit(float(np.log(least / (1 - least))))

    def all_spans(base: Column) -> Column:
        added = F.filter(candidates(text, base), private)
        return F.concat(base, F.transform(added, lambda c: F.struct(c["kind"].alias("kind"), c["rank"].alias("rank"), c["start"].alias("start"), c["end"].alias("end"))))

    return let(base_spans(text), all_spans)


def redact(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row, with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    found = id_and_text(docs, id_col, text_col)
    model = model or train(found)
    base = found.select("doc_id", "text", find_spans(F.col("text"), model).alias("spans"))

    def cut(state: Column, s: Column) -> Column:
        there = s["start"] >= state["at"]
        piece = F.concat(state["made"], F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(there, F.struct(piece.alias("made"), s["end"].alias("at"))).otherwise(state)

    sorted_spans = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    end = F.aggregate(sorted_spans, F.struct(F.lit("").alias("made"), F.lit(0).alias("at")), cut, lambda x: F.concat(x["made"], F.substring(F.col("text"), x["at"] + 1, F.length("text"))))
    return base.select("doc_id", F.when(F.col("text").isNull(), F.lit(None)).otherwise(end).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, and spans as text by kind and start."""

    def count(rule: Base) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == rule.kind)).cast("long").alias(f"n_{rule.kind}")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[count(r) for r in BASE], F.sha2(joined_spans(base, "rank", "start"), 256).alias("base_sha256"), joined_spans(F.col("spans"), "rank", "start").alias("spans"))
