"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

All of it is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandloom.llm.common import free_name, text_or_empty

#: Fixed values. A match can only start where its run of characters starts, or where the last match ended: with that said in the
#: pattern, and with possessive runs, matching is linear in the text and finds what the plain greedy patterns find.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
}
#: What a confirmed match of a kind scores by itself, and words that raise it when they stand nearby.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.9}
CONTEXT = {
    "email": r"mail|contact|address|write|courriel|correo",
    "ip": r"\bip\b|server|host|address|login",
    "card": r"card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|call|tel|mobile|fax|telefon|appel|llam",
    "iban": r"iban|bank|account|konto|compte|cuenta",
}
NEAR = 40
RAISE = 0.2


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _places(x: Column, each) -> Column:
    """each(character as a column, its place from 0) over the characters of x."""
    return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: each(x.substr(i, F.lit(1)), i - 1))


def luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(_places(F.reverse(digits), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    turned = F.concat(iban.substr(F.lit(5), F.length(iban)), iban.substr(1, 4))
    codes = _places(turned, lambda c, _: F.ascii(c))
    step = lambda a, x: F.when(x >= 65, (a * 100 + x - 55) % 97).otherwise((a * 10 + x - 48) % 97)
    return F.aggregate(codes, F.lit(0), step) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) > 3, False).otherwise(F.coalesce(p.substr(-3, 3).cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(hit, r"\."), small)
    if kind == "card":
        return F.when(F.length(_digits(hit)).between(13, 19), luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        return mod97(hit)
    return F.lit(True)


#: A fold that appends to one array copies it each time; it fills arrays of so many spans instead, and an array of those.
FOLD = 256
CHUNK = 1024


def _placed(items: Column, kind_of_items: str, next_pos, keep, made) -> Column:
    """Folds items into an array of made(pos, item) for those with keep(pos, item); pos starts at 0 and moves on to next_pos(pos, item).

    Linear in the number of items, but for what goes on with the square of a 256th of it.
    """
    none = F.expr(f"cast(array() as array<{kind_of_items}>)")
    many = F.expr(f"cast(array() as array<array<{kind_of_items}>>)")

    def step(a: Column, x: Column) -> Column:
        yes, full, grown = keep(a["pos"], x), F.size(a["part"]) >= FOLD - 1, F.concat(a["part"], F.array(made(a["pos"], x)))
        return F.struct(
            next_pos(a["pos"], x).cast("int").alias("pos"),
            F.when(~yes, a["part"]).when(full, none).otherwise(grown).alias("part"),
            F.when(yes & full, F.concat(a["out"], F.array(grown))).otherwise(a["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("pos"), none.alias("part"), many.alias("out"))
    return F.aggregate(items, start, step, lambda a: F.flatten(F.concat(a["out"], F.array(a["part"]))))


def _spans(kind: str, hits: Column, gaps: Column) -> Column:
    """Of the hits and the gaps (the text before, between and after them): confirmed spans with code point offsets."""
    items = F.transform(
        F.sequence(F.lit(0), F.size(hits) - 1),
        lambda i: F.struct(i.cast("int").alias("i"), F.length(gaps[i]).alias("gap"), F.length(hits[i]).alias("hit"), F.coalesce(_confirmed(kind, hits[i]), F.lit(False)).alias("sure")),
    )
    place = lambda pos, x: F.struct((pos + x["gap"]).alias("start"), x["i"].alias("i"))
    sure = _placed(items, "struct<start:int,i:int>", lambda pos, x: pos + x["gap"] + x["hit"], lambda pos, x: x["sure"], place)

    def span(s: Column) -> Column:
        hit = hits[s["i"]]
        near = F.lower(F.concat(F.right(gaps[s["i"]], F.lit(NEAR)), F.lit(" "), F.left(gaps[s["i"] + 1], F.lit(NEAR))))
        return F.struct(
            F.lit(kind).alias("kind"),
            s["start"].alias("start"),
            (s["start"] + F.length(hit)).alias("end"),
            hit.alias("value"),
            F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), F.lit(RAISE)).otherwise(F.lit(0.0))).alias("score"),
        )

    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string,score:double>>)")
    return F.when(F.size(hits) > 0, F.transform(sure, span)).otherwise(none)


def find_pii(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, kinds: tuple[str, ...] = tuple(PATTERNS), into: str = "pii") -> DataFrame:
    """Adds pii (or what into names): array<struct<kind, start, end, value, score>>, by kind and then start; offsets in code points, end exclusive.

    A null text counts as empty and has no spans; whole texts are searched, whatever their length. Each row stands for
    itself: repeated rows give repeated results, an empty table an empty one. keep names the columns that stay beside
    the new one (all, if not given); an own column of its name is replaced, others stay as they are, whatever their names.
    """
    stay = [c for c in (keep if keep is not None else df.columns) if c.lower() != into.lower()]
    own = [F.col(f"`{c}`") for c in stay]
    whole = free_name(df, "__text")
    hits, gaps = ({k: free_name(df, f"__{x}_{k}") for k in kinds} for x in ("hits", "gaps"))
    text = F.col(f"`{whole}`")
    out = df.select(*own, text_or_empty(f"`{text_col}`").alias(whole))
    out = out.select(
        "*",
        *[F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)).alias(hits[k]) for k in kinds],
        *[F.split(text, PATTERNS[k], -1).alias(gaps[k]) for k in kinds],
    )
    return out.select(*own, F.concat(*[_spans(k, F.col(f"`{hits[k]}`"), F.col(f"`{gaps[k]}`")) for k in kinds]).alias(into))


def redact_pii(df: DataFrame, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """The columns of df, with each span in the text replaced by its kind in brackets; overlapping spans count as the first of them.

    A null text stays null; a text without spans stays as it is, and so do all other columns, whatever their names.
    """
    spans_name, chunks_name = free_name(df, "__spans"), free_name(df, "__chunks")
    text, chunks, pii = F.col(f"`{text_col}`"), F.col(f"`{chunks_name}`"), F.col(f"`{spans_name}`")
    found = find_pii(df, text_col, into=spans_name).withColumn(chunks_name, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))

    def part(start: Column, end: Column | None) -> Column:
        """The text from start to end, taken from the chunks that hold it: a substring of the whole text would count all its characters."""
        first = (start / CHUNK).cast("int")
        last = F.size(chunks) - 1 if end is None else F.least((end / CHUNK).cast("int"), F.size(chunks) - 1)
        held = F.array_join(F.slice(chunks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
        return held.substr(start - first * CHUNK + 1, F.length(held) if end is None else end - start)

    spans = F.array_sort(F.transform(F.filter(pii, lambda s: s["score"] >= least_score), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    piece = lambda pos, s: F.struct(pos.alias("pos"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    kept = _placed(spans, "struct<pos:int,start:int,end:int,kind:string>", lambda pos, s: F.greatest(pos, s["end"]), lambda pos, s: s["start"] >= pos, piece)
    before = F.transform(kept, lambda k: F.concat(part(k["pos"], k["start"]), F.lit("["), F.upper(k["kind"]), F.lit("]")))
    last = F.array_max(F.transform(pii, lambda s: F.when(s["score"] >= least_score, s["end"]).otherwise(0)))
    done = F.concat(F.array_join(before, ""), part(last, None))
    return found.select(*[(F.when(F.size(pii) > 0, done).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`")) for c in df.columns])


def pii_digest(df: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds and digests of the spans; a null text counts as empty, a null doc_id stays null."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = ("email", "ip", "card", "phone")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_pii(df, keep=["doc_id"]).select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(said(F.filter("pii", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        said(F.col("pii")).alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)), 3).alias("highest_score"),
    )
