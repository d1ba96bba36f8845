"""Variant spellings of names: symmetric-delete token index and optimal token alignment."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mnemora.operators.components import connected_components
from mnemora.sources import cut

# Forms of address, words without weight, organisation words and their short forms, short given names.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir dame lady lord rev".split())
FILLERS = frozenset("the of and for".split())
ORGANISATION_WORDS = frozenset("""association authority company cooperative corporation department foundation institute partners group trust union
council committee society agency bank university college ministry office limited incorporated works""".split())
SHORT_WORDS = {
    "co": "company", "corp": "corporation", "coop": "cooperative", "dept": "department", "auth": "authority", "assn": "association",
    "assoc": "association", "inst": "institute", "fdn": "foundation", "found": "foundation", "ltd": "limited", "inc": "incorporated", "univ": "university",
}
# Usual English short forms of given names that aren't beginnings of them; those are found by rule (``short_form``).
SHORT_NAMES = """
abigail: gail abby abbie | adelaide: heidi | agnes: nessie | albert: al bert bertie | alexander: al sandy sasha xander lex | alexandra: sandra sandy sasha lexi | alfred: al fred freddie | andrew: drew | angela: angie | ann: nan nancy
anna: nan nancy | anthony: tony | antonia: toni | archibald: baldie | arthur: art | augustus: gus | barbara: babs | bartholomew: bat | beatrice: trixie bea | belinda: lindy | bernard: bernie | bridget: biddy
caroline: carrie lina | catherine: kate kathy katie kitty cat | cecilia: cissy celia | charles: chuck chas | charlotte: lottie lotte | christine: kit tina | christopher: kit topher kester | clementine: clemmie tina | constance: connie | cornelius: neil
deborah: debbie | derek: rick del | dominic: nick nicky | dorothea: dora thea dot dottie dolly | dorothy: dot dottie dolly dora | edmund: ed ned ted eddie | edward: ed ned ted teddy eddie | edwin: ed ned ted | eleanor: nell nellie nora ellie | elizabeth: bess beth betsy betty libby lisa liza lizzie liz eliza elsie lily
emily: millie | emmanuel: manny | eugene: gene | euphemia: effie | evelyn: lynn | florence: flossie | frances: fanny frankie | francis: frank frankie | francesca: fran cesca | franklin: frank | frederick: fritz rick | frederica: ricki
gabriella: ella bella | george: dod | georgina: gina | geraldine: dina | gertrude: trudy gert | gregory: greg | harold: hal | harriet: hattie | helen: nell nellie lena ellie | helena: nell lena ellie | henrietta: etta hetty hettie | henry: hal hank harry
isabella: bella ella izzy izzie tibby | isabel: bel izzy tibby | jacob: jake | james: jim jimmy jamie | jane: jenny | janet: nettie | jean: jennie | jennifer: jenny | jeremiah: jerry | jessica: jessie | joan: jo | john: jack johnny | jonathan: nathan | joseph: jo | josephine: josie posy fifi | judith: judy
katherine: kate kathy katie kitty kay | kathleen: kate kay kitty | laurence: larry lorne | leonard: len lenny | leonora: nora | leopold: poldi | letitia: lettie | louisa: lulu | louise: lulu | lucinda: cindy | madeleine: maddy | magdalena: lena | margaret: maggie meg peggy peg greta rita daisy madge
maria: ria molly | martha: patty mattie | mary: molly polly | matilda: tilly tilda | maximilian: milian | michael: mick micky mike mickey | mildred: millie | millicent: millie | montgomery: monty | nathaniel: nat nate | nicholas: nick nicky klaus colin nico
olivia: liv livvy | oliver: noll | pamela: pam | patricia: patsy tricia trish patty | patrick: paddy | penelope: penny | philippa: pippa | philip: pip | priscilla: cilla | prudence: prue | rebecca: becca becky | richard: dick rick ricky dickie | robert: bob bobby rob bert
roberta: bobbie | roderick: rick | ronald: ronnie | rosalind: ros roz lindy | rosemary: romy | rudolf: rolf dolf | samantha: mantha | samuel: sammy | sarah: sally sadie | sebastian: bastian basti | sophia: fia | stanley: stan | stephen: steve | susan: sukie | susanna: sanna
theodora: dora thea | theodore: ted teddy | theresa: tess tessa terry | thomas: tom tommy | timothy: tim | ursula: ulla | valentina: tina | veronica: ronnie vera nica | victor: vic | victoria: vicky tori toria | vincent: vince | virginia: ginny gina | walter: wally wat | wilhelmina: mina minnie
william: bill billy willy liam | winifred: freda winnie | yvonne: vonnie | zachary: zack zach zak | zoe: zo
"""
#: Letters beyond which a token is indexed by its two ends, of which one edit leaves one as it is; an index of its deletions would grow with the square.
LONGEST = 64
#: Endings of short forms that are the beginning of a given name.
_ENDINGS = ("", "y", "ie", "i", "e", "a", "o")
_ID = T.StructType([T.StructField("form", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType()))])


@cache
def _roots() -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for entry in SHORT_NAMES.replace("\n", "|").split("|"):
        if ":" in entry:
            full, short = entry.split(":")
            for s in [full, *short.split()]:
                out.setdefault(s.strip(), set()).add(full.strip())
    return {k: frozenset(v) for k, v in out.items()}


def roots(token: str) -> frozenset[str]:
    """The full given names that a token may stand for, itself among them."""
    return _roots().get(token, frozenset()) | {token}


def short_form(a: str, b: str) -> bool:
    """Whether one of two given names is a short form of the other by rule: its first three letters or more, and a usual ending."""
    a, b = sorted((a, b), key=len)
    if len(a) < 3 or len(a) >= len(b) or a[:3] != b[:3]:
        return False
    for ending in _ENDINGS:
        stem = a.removesuffix(ending)
        if a.endswith(ending) and len(stem) >= 3 and (b.startswith(stem) or (len(stem) > 3 and stem[-1] == stem[-2] and b.startswith(stem[:-1]))):
            return True
    return False


def deletes(token: str) -> set[str]:
    """Keys of which two tokens one edit apart share one: the token and what any one deletion leaves of it; a long token's two ends."""
    keys = {token}
    if len(token) >= LONGEST:
        half = LONGEST // 2
        keys |= {f"^{token[:half]}", f"{token[-half:]}$"}
    if len(token) <= LONGEST:
        keys |= {token[:i] + token[i + 1 :] for i in range(len(token))}
    return keys


def within_one(a: str, b: str) -> bool:
    """Whether at most one insertion, deletion, change or swap of neighbours makes one of the other."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def alike(a: str, b: str) -> bool:
    """Whether two tokens may be spellings of one: one edit apart, but of tokens of 3 letters only where letters are swapped or one is added; shorter ones must be equal."""
    return a == b or (min(len(a), len(b)) >= 3 and (max(len(a), len(b)) >= 4 or sorted(a) == sorted(b)) and within_one(a, b))


def parse_name(raw: str | None, hint: str | None) -> tuple[str, list[str]] | None:
    """Form (p person, o organisation, m single word) and plain tokens of a name; persons with given names first.

    The name itself decides: a word for organisations or a closing acronym makes it one; ``hint``, the kind of the row,
    which may be wrong, only tells for three words or more. Null where nothing is left.
    """
    s = unicodedata.normalize("NFKC", raw or "").strip()
    s = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z])", " ", s)
    s = re.sub(r"\b([Cc])o-op\b", r"\1oop", s)
    folded = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    parts = [re.findall(r"[^\W_]+", p) for p in folded.split(",")]
    tokens = [SHORT_WORDS.get(t, t) for p in parts for t in p]
    has_word = any(t in ORGANISATION_WORDS or (len(t) > 6 and any(len(w) > 6 and within_one(t, w) for w in ORGANISATION_WORDS)) for t in tokens)
    short = len(tokens) == 2 and bool(re.search(r"\s[A-Z]{2,3}\.?$", s))
    hint = (hint or "").strip().lower()[:1]
    if has_word or short or (hint == "o" and len(tokens) > 2):
        tokens = [t for t in tokens if t not in FILLERS or len(tokens) == 1]
        return ("o" if len(tokens) > 1 else "m", tokens) if tokens else None
    if len(parts) == 2 and len(parts[0]) and len(parts[1]):
        parts = [parts[1], parts[0]]
    tokens = [t for p in parts for t in p]
    while len(tokens) > 1 and tokens[0] in TITLES:
        tokens = tokens[1:]
    if not tokens:
        return None
    return ("p" if len(tokens) > 1 else "m"), tokens


def shortens(a: str, b: str) -> bool:
    """Whether ``a`` is a written abbreviation of ``b``: same first letter, its letters in order within ``b``."""
    if not 2 <= len(a) < len(b) - 1 or a[0] != b[0]:
        return False
    rest = iter(b)
    return all(c in rest for c in a)


def _token_cost(a: str, b: str, person: bool) -> float | None:
    """Cost of taking two tokens for one: 0 equal, 0.2 short form, 1 an edit, 3 initial; None if they don't fit."""
    if a == b:
        return 0.0
    if len(a) == 1 or len(b) == 1:
        letters = {r[0] for r in roots(b if len(a) == 1 else a)} if person else {(b if len(a) == 1 else a)[0]}
        return 3.0 if (a if len(a) == 1 else b) in letters else None
    if person and (roots(a) & roots(b) or short_form(a, b)):
        return 0.2
    if not person and (shortens(a, b) or shortens(b, a)):
        return 0.2
    if min(len(a), len(b)) >= 3 and max(len(a), len(b)) >= 4:
        if within_one(a, b):
            return 1.0
        if person and any(len(x) >= 5 and len(y) >= 5 and within_one(x, y) for x in roots(a) for y in roots(b)):
            return 1.2
        if not person and any(within_one(x[: len(y)], y) and x[0] == y[0] for x, y in ((a, b), (b, a)) if len(x) - 2 > len(y) >= 4):
            return 1.2
    return None


def align(form: str, a: list[str], b: list[str]) -> str | None:
    """How two names fit, without their anchor tokens: 'full', 'weak' (by an initial or an acronym) or None.

    The tokens are assigned to one another at the least total cost. Persons must agree in the first given name, and
    further ones may be absent on one side only; organisations must agree in all words. More than two edits don't fit.
    """
    if form == "m":
        return "full"
    if form == "o":
        for x, y in ((a, b), (b, a)):
            if len(x) == 1 and len(y) > 1 and len(x[0]) == len(y) and sorted(x[0]) == sorted(t[0] for t in y):
                return "weak"
        if len(a) != len(b) or not a:
            return None
        best = _least(a, b, False)
        return None if best is None or best > 2.5 else "full"
    if not a or not b:
        return None
    first = _token_cost(a[0], b[0], True)
    if first is None:
        return None
    more = _least(*sorted((a[1:], b[1:]), key=len), True)
    if more is None or first % 3 + more % 3 > 2.5:
        return None
    return "weak" if first == 3.0 else "full"


def _least(a: list[str], b: list[str], person: bool) -> float | None:
    """The least total cost of giving each token of ``a`` another one of ``b``, which has as many or more; None if they can't all be given one.

    Shortest augmenting paths with potentials (Hungarian method): polynomial in the number of tokens.
    """
    never = 1e6
    rows, cols = len(a), len(b)
    price: dict[tuple[str, str], float] = {}
    for x in a:
        for y in b:
            if (x, y) not in price:
                c = _token_cost(x, y, person)
                price[x, y] = never if c is None else c
        if all(price[x, y] == never for y in b):
            return None
    u, v, owner = [0.0] * (rows + 1), [0.0] * (cols + 1), [0] * (cols + 1)
    for i in range(1, rows + 1):
        owner[0], at = i, 0
        least, back, done = [float("inf")] * (cols + 1), [0] * (cols + 1), [False] * (cols + 1)
        while owner[at]:
            done[at] = True
            row, step, to = owner[at], float("inf"), 0
            for j in range(1, cols + 1):
                if not done[j]:
                    c = price[a[row - 1], b[j - 1]] - u[row] - v[j]
                    if c < least[j]:
                        least[j], back[j] = c, at
                    if least[j] < step:
                        step, to = least[j], j
            for j in range(cols + 1):
                if done[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = to
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    total = sum(price[a[owner[j] - 1], b[j - 1]] for j in range(1, cols + 1) if owner[j])
    return None if total >= never else round(total, 9)


def _rest_key(form: str, rest: list[str]) -> str:
    """A key that the rest of a word or of an organisation's name shares with those of names that fit."""
    if form == "m":
        return "m"
    return "".join(sorted(rest[0])) if len(rest) == 1 and len(rest[0]) <= 3 else "".join(sorted(t[0] for t in rest))


@F.pandas_udf(_ID)
def _parsed(raw: pd.Series, hint: pd.Series) -> pd.DataFrame:
    out = [parse_name(r, h) for r, h in zip(raw, hint)]
    return pd.DataFrame({"form": [o and o[0] for o in out], "tokens": [o and o[1] for o in out]})


@F.pandas_udf(T.ArrayType(T.StringType()))
def _deletes(token: pd.Series) -> pd.Series:
    return token.map(lambda t: sorted(deletes(t)))


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(x, y) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.StringType())
def _key_of_rest(form: pd.Series, rest: pd.Series) -> pd.Series:
    return pd.Series([None if f == "p" else _rest_key(f, list(r)) for f, r in zip(form, rest)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _roots_of(token: pd.Series) -> pd.Series:
    return token.map(lambda t: sorted(roots(t)))


@F.pandas_udf(T.StringType())
def _fit(form: pd.Series, anchor_a: pd.Series, rest_a: pd.Series, anchor_b: pd.Series, rest_b: pd.Series) -> pd.Series:
    return pd.Series([
        align(f, list(x), list(y)) if alike(p, q) else None for f, p, x, q, y in zip(form, anchor_a, rest_a, anchor_b, rest_b)], dtype=object)


def _token_keys(names: DataFrame) -> DataFrame:
    """Each token with its rarity and block keys: token, weight, keys, given (keys as a given name), initials.

    The keys of a token are its own and those of the commoner tokens one edit apart. So of two tokens that may be one, one
    has the other's key, a token with many misspellings has no more keys than a rare one, and no chain of edits ties others
    to them. A key of the index has at most a token for each letter and place.
    """
    # the full forms of the list of short names take part, whether they occur or not
    full = names.sparkSession.createDataFrame([(n, 0) for n in sorted(set().union(*_roots().values()))], "token string, n long")
    known = cut(names.select(F.explode("tokens").alias("token"), F.lit(1).cast("long").alias("n")).unionAll(full).groupBy("token").agg(F.sum("n").alias("df")))
    index = known.where(F.length("token") >= 3).select("token", "df", F.explode(_deletes("token")).alias("key"))
    x, y = index.select("key", F.struct("df", "token").alias("x")), index.select("key", F.struct("df", "token").alias("y"))
    near = x.join(y, "key").where("x.token < y.token").select("x", "y").distinct().where(_alike("x.token", "y.token"))
    sides = near.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.*")
    around = sides.groupBy(F.col("x.token").alias("token")).agg(F.sum("y.df").alias("more"), F.collect_list(F.when(F.col("y") > F.col("x"), F.xxhash64("y.token"))).alias("commoner"))
    own = F.array(F.xxhash64("token"))
    tokens = cut(known.join(around, "token", "left").select("token", (F.col("df") + F.coalesce("more", F.lit(0))).alias("weight"), F.coalesce(F.concat(own, "commoner"), own).alias("keys")))
    # a token of the list of short forms has the keys of all names it may stand for
    listed = known.where(F.col("token").isin(sorted(_roots()))).select("token", F.explode(_roots_of("token")).alias("root"))
    given = listed.join(tokens.select(F.col("token").alias("root"), "keys"), "root").groupBy("token").agg(
        F.array_distinct(F.flatten(F.collect_list("keys"))).alias("given"), F.collect_set(F.substring("root", 1, 1)).alias("initials"))
    return cut(tokens.join(given, "token", "left").select("token", "weight", "keys", F.coalesce("given", "keys").alias("given"), F.coalesce("initials", F.array(F.substring("token", 1, 1))).alias("initials")))


def candidates(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of names (name, form, tokens) that may fit, and the weak ones: (form, a, anchor_a, rest_a, weak_a, and so for b), (name).

    A name is blocked by anchor tokens and by keys of the rest: a person's by the first, the last and the rarest token
    and the given name, an organisation's by its two rarest words and the initials of the others. Weak names, of which
    only an initial or an acronym is known beside the anchor, meet the others by initials, and never each other.
    """
    tokens = _token_keys(names)
    n = F.size("tokens")
    person = F.col("form") == "p"
    few = lambda t: F.length(t) <= 3
    weak = F.when(person, (F.length(F.col("tokens")[0]) == 1) | (F.size(F.filter("tokens", lambda t: F.length(t) == 1)) == n - 1)).otherwise((F.col("form") == "o") & (n == 2) & F.exists("tokens", few))
    names = names.withColumn("weak", weak)
    at = names.select("name", "form", "weak", "tokens", n.alias("n"), F.posexplode("tokens").alias("pos", "token")).where("form <> 'p' OR length(token) > 1").join(tokens.select("token", "weight", "keys"), "token")
    # a known given name or a short form is the main anchor only where there is no other token, however rare its spelling
    order = [(F.length("token") < 3), (F.col("token").isin(sorted(_roots())) | (F.length("token") < 5)) & person, F.col("weight"), F.negative(F.length("token")), F.col("token"), F.col("pos")]
    anchors = at.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(*order))).where("place = 1 OR (form = 'o' AND place = 2) OR (form = 'p' AND (pos = 0 OR pos = n - 1))")
    blocked = anchors.select(
        "name", "form", "weak", F.col("token").alias("anchor"), "keys", F.expr("pos = n - 1").alias("last"), F.expr("place > 1 AND pos < n - 1 AND form = 'p'").alias("extra"), F.filter("tokens", lambda t, i: i != F.col("pos")).alias("rest"))
    blocked = blocked.withColumn("g", F.get("rest", F.lit(0)))
    blocked = blocked.join(tokens.select(F.col("token").alias("g"), "given", "initials"), "g", "left").withColumn("other", _key_of_rest("form", "rest"))
    none = F.array().cast("array<bigint>")
    by_name = F.concat(F.coalesce("given", none), F.when(F.length("g") >= 3, F.array(F.xxhash64(F.lit("h"), F.substring("g", 1, 3)))).otherwise(none))
    by_initial = F.transform(F.coalesce("initials", F.array().cast("array<string>")), lambda x: F.xxhash64(F.lit("i"), x))
    second = F.when(person, F.when(F.col("role") == "weak", by_initial).otherwise(by_name)).otherwise(F.array(F.xxhash64("other")))
    roles = F.explode(F.when(F.col("weak"), F.array(F.lit("weak"))).otherwise(F.array(F.lit("weak"), F.lit("full")))).alias("role")
    keyed = blocked.select("*", roles).withColumn("second", second).select("form", "role", "weak", "name", "anchor", "rest", "last", "extra", "keys", F.explode("second").alias("s"))
    keyed = cut(keyed.select("form", "role", "weak", "name", "anchor", "rest", "last", "extra", "s", F.explode("keys").alias("k")).withColumn("block", F.xxhash64("role", "form", "k", "s")).drop("s", "k"))
    side = lambda where, end: keyed.where(where).select("block", "form", *[F.col(c).alias(c + end) for c in ("name", "anchor", "rest", "weak", "last", "extra")])
    full = side("role = 'full'", "_a").join(side("role = 'full'", "_b").drop("form"), "block").where("name_a < name_b")
    half = side("role = 'weak' AND weak", "_a").join(side("role = 'weak' AND NOT weak", "_b").drop("form"), "block")
    pairs = full.unionByName(half).where("NOT (extra_a AND NOT last_b) AND NOT (extra_b AND NOT last_a)")
    # a block also holds the misspellings of one token, two edits apart; a swap is two edits to this distance
    far = F.levenshtein("anchor_a", "anchor_b", 2)
    letters = lambda c: F.array_sort(F.split(c, ""))
    pairs = pairs.where(F.when(F.col("anchor_a") == F.col("anchor_b"), True).when(far < 0, False).when(far < 2, True).otherwise(letters("anchor_a") == letters("anchor_b")))
    pairs = pairs.select("form", F.col("name_a").alias("a"), "anchor_a", "rest_a", "weak_a", F.col("name_b").alias("b"), "anchor_b", "rest_b", "weak_b").distinct()
    return pairs, names.where("weak").select("name")


def link_names(rows: DataFrame, row_id: Column, name: Column, aliases: Column, kind: Column) -> DataFrame:
    """The entity of every row: id, class_id (the least id of the rows that name it).

    Names of a row are its name and its aliases; null, blank and repeated ones don't matter, null ids are left out,
    rows without a usable name are entities of their own. Names are taken apart into plain tokens (case, accents,
    titles and punctuation don't matter). A symmetric-delete index over the distinct tokens finds those one edit
    apart; names are blocked by rare tokens and keys of the rest (``candidates``), so no common token makes a block. Tokens
    of candidates are aligned at the least cost. Names that fit in full are joined; one that has only an initial or an
    acronym is joined where exactly one entity fits. Links are transitive.
    """
    base = rows.select(row_id.cast("long").alias("id"), name.alias("name"), aliases.alias("aliases"), kind.alias("kind")).where("id IS NOT NULL")
    raw = base.select("id", "kind", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("raw")).where("raw IS NOT NULL")
    named = raw.select("id", _parsed("raw", "kind").alias("n")).where("n.form IS NOT NULL").select("id", "n.form", "n.tokens").withColumn("name", F.xxhash64("form", "tokens").bitwiseOR(F.lit(1)))
    named = cut(named.distinct())
    pairs, weak = candidates(named.select("name", "form", "tokens").distinct())
    weak = cut(weak.withColumn("weak", F.lit(True)))
    fits = cut(pairs.withColumn("fit", _fit("form", "anchor_a", "rest_a", "anchor_b", "rest_b")).where("fit IS NOT NULL").select("a", "b", "weak_a", "weak_b").distinct())

    strong = fits.where("NOT weak_a AND NOT weak_b").select("a", "b")
    own = named.join(weak, "name", "left_anti").select((F.col("id") * 2).alias("a"), F.col("name").alias("b"))
    first = cut(connected_components(own.unionAll(strong)))
    entity = base.select("id").distinct().join(first.select((F.col("node") / 2).cast("long").alias("id"), "component", (F.col("node") % 2 == 0).alias("even")).where("even").drop("even"), "id", "left").select("id", F.coalesce("component", F.col("id") * 2).alias("part"))
    entity = cut(entity)

    # a weak name goes to the one entity that fits it, or else to the others of the same weak name
    part_of = first.select(F.col("node").alias("full"), F.col("component").alias("to"))
    meant = fits.where("weak_a <> weak_b").select(F.when(F.col("weak_a"), F.col("a")).otherwise(F.col("b")).alias("name"), F.when(F.col("weak_a"), F.col("b")).otherwise(F.col("a")).alias("full")).join(part_of, "full").select("name", "to").distinct()
    choice = meant.groupBy("name").agg(F.count("*").alias("n"), F.min("to").alias("to"))
    used = named.join(weak, "name").select("id", "name").join(entity, "id").select("part", "name").distinct()
    served = used.join(meant.withColumnRenamed("to", "part"), ["part", "name"], "left_semi").withColumn("served", F.lit(True))
    open_uses = used.join(served, ["part", "name"], "left").where("served IS NULL").join(choice, "name", "left")
    ties = open_uses.where("n = 1").select(F.col("part").alias("a"), F.col("to").alias("b")).unionAll(open_uses.where("n IS NULL").select("part", F.col("name")))
    joined = connected_components(ties).select(F.col("node").alias("part"), F.col("component").alias("final"))
    whole = entity.join(joined, "part", "left").select("id", F.coalesce("final", "part").alias("part"))
    least = whole.groupBy("part").agg(F.min("id").alias("class_id"))
    return whole.join(least, "part").select("id", "class_id")
