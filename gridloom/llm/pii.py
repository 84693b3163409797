"""Information-theoretic sanitising of personal data, in DataFrame functions only.

Protected entities are the personal data that patterns find (e-mail, IP, card, phone), and the
class that each belongs to: a mail domain, a network, an issuer, an area. Values are mostly seen
once or twice; their classes give them a corpus. With counts of distinct texts N, df(e), df(t)
and co(e, t), all over whole texts,

    IC(e)  = log2(N / df(e))            information of the entity
    PMI    = log2(co * N / (df(e) df(t)))
    disclosure(e, t) = PMI / IC(e)      1: the term gives the entity away

Terms at or over `remove_at` are removed, those at or over `generalise_at` are replaced by the
kind of word they are (a name, an acronym, a term), wherever they stand in the documents that
hold the entity. A pair must stand out from chance: co * PMI, in bits, is at least `evidence` *
log2(N), as more texts have more pairs that meet by chance. So an entity seen once is given away by
terms that its one text alone has; one seen more often needs `support` texts with the term.
Copies of a text count once.

Plan: one scan finds the patterns and keeps the texts that match, another counts hashes of each
distinct text's terms. Only texts with an entity that has support meet their terms.

Defined results for odd rows: null text is empty; repeated rows give repeated results;
documents without personal data keep their text; an entity found in every text has
IC 0 and no term discloses it; columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm._shared import joined, materialise, row_of, spans, tagged, text_key

KINDS = ("email", "ip", "card", "phone")

# Possessive forms of the contract's patterns: same matches, no backtracking over long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{4,}+"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(
            F.substring(d, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(d, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return total % 10 == 0


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Add `__base`: array of struct(kind, s, e, v) by kind as listed, then start."""
    t = F.col(text)
    digit = t.rlike("[0-9]")
    df = spans(docs, "__email", text, EMAIL, t.contains("@"))
    df = spans(df, "__ip", text, IP, digit)
    df = spans(df, "__card", text, CARD, digit)
    df = spans(df, "__phone", text, PHONE, t.contains("+"))
    in_range = F.filter("__ip", lambda x: F.forall(F.split(x["v"], r"\."), lambda p: p.cast("double") <= 255))
    sized = F.filter("__card", lambda x: F.length(_digits(x["v"])).between(16, 19))
    phones = F.filter("__phone", lambda x: F.length(_digits(x["v"])).between(8, 15))
    df = df.withColumn("__ip", in_range).withColumn("__card", sized).withColumn("__phone", phones)
    df = df.withColumn("__card", F.filter("__card", lambda x: _luhn(x["v"])))
    return df.withColumn("__base", F.concat(*[tagged(f"__{k}", k) for k in KINDS])).drop(*[f"__{k}" for k in KINDS])


def _entities(base: Column) -> Column:
    """Distinct entities of a text: each value, and the class it belongs to."""

    def of(x: Column) -> Column:
        v = F.lower(x["v"])
        part = (
            F.when(x["kind"] == "email", F.regexp_extract(v, "@(.*)$", 1))
            .when(x["kind"] == "ip", F.regexp_extract(v, r"^(.*)\.", 1))
            .when(x["kind"] == "card", F.substring(_digits(v), 1, 6))
            .otherwise(F.substring(_digits(v), 1, 4))
        )
        return F.array(F.concat_ws(":", x["kind"], v), F.concat_ws("/", x["kind"], part))

    return F.array_distinct(F.flatten(F.transform(base, of)))


def _scan(docs: DataFrame, carry: list[str]) -> DataFrame:
    """A row per row of docs: r (its columns `carry`), text_hash, base, and text where base is not empty."""
    rows = docs.select(row_of(carry).alias("r"), F.coalesce("text", F.lit("")).alias("text"))
    rows = base_spans(rows, "text").withColumnRenamed("__base", "base")
    return materialise(rows.select("r", text_key(F.col("text")).alias("text_hash"), "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "pii-scan")


def _terms(text: Column) -> Column:
    """Hashes of a text's distinct terms."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda x: F.xxhash64(F.lower(x))))


def disclosing(docs: DataFrame, personal: DataFrame, n: int, *, support: int, evidence: float, generalise_at: float) -> DataFrame:
    """text_hash, term (hash), disclosure: what each text with an entity holds that gives one of its entities away.

    personal: text_hash, text, base of the distinct texts with an entity; n: distinct texts.
    """
    # each distinct text counts once; terms are counted before they meet the entities: vocabularies are joined, not occurrences
    once = docs.select(text_key(F.col("text")).alias("text_hash"), _terms(F.coalesce("text", F.lit(""))).alias("terms")).groupBy("text_hash").agg(F.first("terms").alias("terms"))
    df_t = materialise(once.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df_t")), "pii-terms")
    held = personal.select("text_hash", _entities(F.col("base")).alias("entities"), _terms(F.col("text")).alias("terms"))
    mentions = held.select("text_hash", F.explode("entities").alias("entity"))
    df_e = mentions.groupBy("entity").agg(F.count("*").alias("df_e"), F.first("text_hash").alias("only"))
    bits = math.log2(max(n, 1))

    def over(co: Column, df_e: Column) -> tuple[Column, Column]:
        info = F.log2(F.lit(float(n)) / df_e)
        pmi = F.log2(co * F.lit(float(n)) / (df_e * F.col("df_t")))
        return (info > 0) & (co * pmi >= evidence * bits - 1e-9) & (pmi / info >= generalise_at), (pmi / info).alias("disclosure")

    # an entity seen once: its one text has all of its terms, each once
    passes, disclosure = over(F.lit(1), F.lit(1))
    alone = df_e.where("df_e = 1").select(F.col("only").alias("text_hash")).distinct()
    of_one = held.join(alone, "text_hash", "left_semi").select("text_hash", F.explode("terms").alias("term")).join(df_t.where(passes), "term").select("text_hash", "term", disclosure)
    # an entity seen more often
    met = mentions.join(df_e.where("df_e > 1").select("entity", "df_e"), "entity").join(held.select("text_hash", "terms"), "text_hash").select("text_hash", "entity", "df_e", F.explode("terms").alias("term"))
    met = materialise(met, "pii-met")
    pairs = met.groupBy("entity", "term").agg(F.count("*").alias("co"), F.first("df_e").alias("df_e")).where(F.col("co") >= support)
    passes, disclosure = over(F.col("co"), F.col("df_e"))
    of_more = met.join(pairs.join(df_t, "term").where(passes).select("entity", "term", disclosure), ["entity", "term"]).select("text_hash", "term", "disclosure")
    return of_one.unionByName(of_more).groupBy("text_hash", "term").agg(F.max("disclosure").alias("disclosure"))


_NONE = "array<struct<kind:string,s:int,e:int,v:string>>"


def _found(docs: DataFrame, carry: list[str], *, support: int = 2, evidence: float = 1.0, generalise_at: float = 0.7, remove_at: float = 0.9) -> DataFrame:
    """One row per row of docs: r (its columns `carry`), base, and more: disclosing terms as
    struct(kind: generalise or remove, s, e, v) by kind, then start."""
    scanned = _scan(docs, carry)
    n = scanned.select("text_hash").distinct().count()
    personal = scanned.where(F.size("base") > 0)
    texts = materialise(personal.groupBy("text_hash").agg(F.first("text").alias("text"), F.first("base").alias("base")), "pii-texts")
    told = disclosing(docs, texts, n, support=support, evidence=evidence, generalise_at=generalise_at)
    # places of all words of a text that holds such a term: running sums, linear in the text
    some = texts.join(told.select("text_hash").distinct(), "text_hash", "left_semi")
    found = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    words = some.select("text_hash", F.posexplode(F.arrays_zip(found.alias("v"), F.split("text", TERM, -1).alias("gap"))).alias("i", "x")).where(F.col("x.v").isNotNull())
    end = F.sum(F.length("x.gap") + F.length("x.v")).over(Window.partitionBy("text_hash").orderBy("i")).cast("int")
    words = words.select("text_hash", F.xxhash64(F.lower("x.v")).alias("term"), (end - F.length("x.v")).alias("s"), end.alias("e"), F.col("x.v").alias("v"))
    kind = F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise").alias("kind")
    marks = words.join(told, ["text_hash", "term"]).groupBy("text_hash").agg(F.array_sort(F.collect_list(F.struct(kind, "s", "e", "v"))).alias("marks"))
    free = F.filter("marks", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))
    more = texts.join(marks, "text_hash").select(F.col("text_hash").alias("h"), free.alias("more"))
    none = F.array().cast(_NONE)
    # rows without personal data, most of the table, meet nothing
    met = personal.join(more, F.col("text_hash") == F.col("h"), "left").select("r", "base", F.coalesce("more", none).alias("more"))
    return met.unionByName(scanned.where(F.size("base") == 0).select("r", "base", none.alias("more")))


def find(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, base and more, arrays of struct(kind, s, e, v) by kind, then start."""
    return _found(docs, ["doc_id"], **options).select("r.doc_id", "base", "more")


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with personal data in `text` replaced by <KIND>, disclosing terms removed or replaced
    by the kind of word they are; every other column and row stays, null text stays null."""
    found = _found(docs, docs.columns, **options)
    marks = F.array_sort(F.transform(F.concat("base", "more"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["v"].alias("v"))))
    # overlapping spans melt into one that bears the first one's kind
    none = F.array().cast("array<struct<s:int,e:int,kind:string,v:string>>")

    def melt(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(last.withField("e", F.greatest(last["e"], x["e"]))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["s"] < last["e"], grown).otherwise(F.concat(acc, F.array(x)))

    both = found.select("r", F.col("r.text").alias("text"), F.aggregate(marks, none, melt).alias("marks"))

    def word(x: Column) -> Column:
        shape = F.when(x["v"].rlike(r"^\p{Lu}+$"), "<ACRONYM>").when(x["v"].rlike(r"^\p{Lu}"), "<NAME>").otherwise("<TERM>")
        return F.when(x["kind"] == "remove", "").when(x["kind"] == "generalise", shape).otherwise(F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))

    def piece(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at("marks", F.greatest(i, F.lit(1)))["e"])
        return F.concat(F.substring("text", before + 1, x["s"] - before), word(x))

    tail = F.substring("text", F.try_element_at("marks", F.lit(-1))["e"] + 1, F.length("text"))
    fresh = F.when(F.size("marks") > 0, F.concat(F.array_join(F.transform("marks", piece), ""), tail)).otherwise(F.col("text"))
    row = F.col("r").withField("text", fresh)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.size("marks") > 0, F.length(fresh)).otherwise(F.col("r.n_chars")).cast(docs.schema["n_chars"].dataType))
    return both.select(row.alias("r")).select("r.*")


def report(docs: DataFrame, **options) -> DataFrame:
    """The contract's digest of `find`."""
    found = find(docs, **options)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = joined(F.col("base"))
    return found.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        joined(F.concat("base", "more")).alias("spans"),
        F.size("more").cast("long").alias("n_terms"),
    )
