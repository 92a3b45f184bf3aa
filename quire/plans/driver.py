"""Stand-in inputs built from the driver tables.

The driver has no theory files, models or predictions, so each group of jobs is
exercised on tables Spark derives from the given parquet files (all of them, every
row): ``part`` gives examples and candidate texts, ``documents`` gives theory text
and statements, ``pages`` gives paths, ``orders``/``lineitem``/``part`` give lemmas
with symbols and definitions, ``conversations`` gives prompts, ``events`` gives
logs and stage results.  Every derivation is an expression, an explode of a
fixed-size array, or an equi-join on a computed key, so it grows with the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import large_join

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Candidate slots per strategy: (strategy, slot, key offset of the neighbour part).
PREDICTION_OFFSETS = [
    ("greedy", 1, 1),
    ("beam-search", 1, -2), ("beam-search", 2, -1), ("beam-search", 3, 1), ("beam-search", 4, 2),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The most scans that a table is read by.
MAX_SHARES = 16


def table_shares(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Every row of a table once, in as many tasks a row group as there are cores, without a shuffle: each task
    reads the row group and keeps its share, by the rows' places in the file.  For tables that are small on disk
    but whose rows are much work each, more than reading them once a core."""
    n = min(max(spark.sparkContext.defaultParallelism, 1), MAX_SHARES)
    t = table(spark, sf_dir, name)
    shares = [t.where(F.col("_metadata.row_index") % n == i) for i in range(n)]
    return reduce(DataFrame.union, shares)


# --- scoring inputs from `part` ---------------------------------------------

def part_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """examples: one row per part.  ``template`` is the part name; ``lemma_object``
    a statement with ``?`` variables made of the name words."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("row_id"),
        F.concat(F.lower("p_type"), F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("theory_file"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string")).alias("lemma_name"),
        F.col("p_name").alias("template"),
        _lemma_object(F.col("p_type"), F.col("p_name")).alias("lemma_object"),
    )


def _lemma_object(ptype, pname):
    return F.concat(ptype, F.lit(" (?"), F.replace(pname, F.lit(" "), F.lit(" ?")), F.lit(") = ?"),
                    F.substring_index(pname, " ", 1))


def part_predictions(spark: SparkSession, sf_dir: str, task: str = "template", known_only: bool = True) -> DataFrame:
    """predictions(row_id, strategy, candidates): the k candidates of a part are texts
    of its key neighbours (greedy: next part; beam-search: the two before and after),
    decorated the way generated text is (outer spaces, end mark and trailing junk;
    for the lemma task, renamed variables).  ``known_only`` leaves out predictions for keys that no
    part has."""
    p = table(spark, sf_dir, "part")
    offsets = F.array(*[
        F.struct(F.lit(s).alias("strategy"), F.lit(slot).alias("slot"), F.lit(o).cast("long").alias("off"))
        for s, slot, o in PREDICTION_OFFSETS
    ])
    if task == "template":
        text = F.concat(F.lit("  "), F.col("p_name"), F.lit("  ###end "), F.col("p_type"))
    else:
        text = F.concat(F.replace(_lemma_object(F.col("p_type"), F.col("p_name")), F.lit("?"), F.lit("?v")), F.lit("###end"))
    # every text goes straight to the parts that it is a candidate of
    sent = p.select("p_partkey", text.alias("text"), F.explode(offsets).alias("o")).select(
        (F.col("p_partkey") - F.col("o.off")).alias("row_id"), "o.strategy", "o.slot", "text")
    if known_only:
        sent = large_join(sent, p.select(F.col("p_partkey").alias("row_id")), "row_id", "left_semi")
    return (
        sent.groupBy("row_id", "strategy")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "text"))).alias("c"))
        .select("row_id", "strategy", F.col("c.text").alias("candidates"))
    )


# --- theory text and statements from `documents` ------------------------------

def document_theories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """theories(theory_file, session, block, text): every document becomes a theory (of the session
    named by its ``source``); each of its lines becomes one command (lemma / unnamed theorem /
    definition / fun / text)."""
    d = table(spark, sf_dir, "documents")
    lines = F.split(F.col("text"), "\n")
    cmds = F.transform(lines, _cmd)
    theory = F.concat("source", F.lit("/T"), F.col("doc_id").cast("string"))
    return d.select(theory.alias("theory_file"), F.col("source").alias("session"), F.col("doc_id").alias("block"),
                    F.array_join(cmds, "\n").alias("text"))


def _cmd(line, i):
    w = F.regexp_extract(line, r"^([^ ]*)", 1)
    rest = F.substring(line, F.length(w) + 2, F.lit(2147483647))
    m = i % 5
    return (
        F.when(m == 0, F.concat(F.lit("lemma "), w, F.lit(': "'), rest, F.lit('"')))
        .when(m == 1, F.concat(F.lit('theorem "'), line, F.lit('"')))
        .when(m == 2, F.concat(F.lit("definition "), w, F.lit(' where "'), rest, F.lit('"')))
        .when(m == 3, F.concat(F.lit("fun "), w, F.lit(' :: "'), rest, F.lit('"')))
        .otherwise(F.concat(F.lit("text \\<open>"), line, F.lit("\\<close>")))
    )


# What stands before and behind a line, by its place in a period of lines.  Command words stand at line starts inside comments,
# cartouches, strings and verbatim text, at depths up to two.
NESTED = [
    ("lemma a: \"", "\""), ("(* outer ", ""), ("lemma inside (* nested *) ", ""), ("definition b ", " *)"),
    ("text \\<open>", ""), ("theorem ‹inner› \" ", ""), ("by simp ", "\\<close>"), ("lemma c: \"first \\\" ", ""),
    ("fun in_string ", "\\\\\""), ("definition d where \"", "\""), ("lemma `alt ", ""), ("fun alt (* ", "`"),
    ("ML {* val x = ", ""), ("theorem in_verbatim ` ", " *}"), ("  theorem e: ‹", "›"),
]


def nested_theories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """theories(theory_file, text): every document as a theory whose lines stand in nested outer syntax."""
    d = table(spark, sf_dir, "documents")
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in NESTED])
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.concat(
        F.element_at(pairs, i % len(NESTED) + 1)["a"], line, F.element_at(pairs, i % len(NESTED) + 1)["b"]))
    return d.select(F.concat("source", F.lit("/T"), F.col("doc_id").cast("string")).alias("theory_file"), F.array_join(lines, "\n").alias("text"))


def importing_theories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """theories(theory_file, text): every document as a theory T<id> that imports T<id div 3> and declares
    a command named after its first word; its lines begin in turn with ``lemma``, with that command, with
    the one of the theory it imports, and with the one of T<id + 1>, which it mostly doesn't import."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    word = F.coalesce(F.nullif(F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)), F.lit("")), F.lit("empty"))
    named = F.concat(word, F.lit("_cmd"))
    d = d.withColumn("own", named).withColumn("parent", F.floor(F.col("doc_id") / 3))
    up = d.select(F.col("doc_id").alias("parent"), F.col("own").alias("up"))
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("own").alias("after"))
    # the words meet the ids first, so the texts move once
    words = d.select("doc_id", "parent").distinct().join(up, "parent", "left").join(after, "doc_id", "left").select("doc_id", "up", "after")
    j = d.join(words, "doc_id", "left")
    starts = F.array(F.lit("lemma"), F.col("own"), F.coalesce(F.col("up"), F.lit("none_cmd")), F.coalesce(F.col("after"), F.lit("none_cmd")))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.element_at(starts, i % 4 + 1), F.lit(" "), line))
    header = F.concat(F.lit("(* header *)\ntheory T"), F.col("doc_id").cast("string"), F.lit("\n  imports Main \"Lib.T"), F.col("parent").cast("string"),
                      F.lit("\"\n  keywords \""), F.col("own"), F.lit("\" :: thy_decl and \"none_cmd\" \"is\" and \"maybe_cmd\" :: quasi_command\nbegin\n"))
    return j.select(F.concat("source", F.lit("/T"), F.col("doc_id").cast("string")).alias("theory_file"), F.concat(header, F.array_join(lines, "\n")).alias("text"))


# --- lemmas, symbols and definitions from `orders`, `lineitem`, `part` ---------
# A lemma is an order; its file is its customer; its symbols are the parts of its
# line items written in the four dotted forms a symbol lookup meets (one dot, two
# dots, a `_class` segment, no dot); definitions are parts, filed by part key.

def _part_theory(partkey):
    return F.concat(F.lit("Thy"), F.floor(partkey / 4).cast("string"))


def _symbol(partkey, line):
    thy, base = _part_theory(partkey), F.concat(F.lit("p"), partkey.cast("string"))
    m = line % 4
    return (F.when(m == 0, F.concat(thy, F.lit("."), base))
            .when(m == 1, F.concat(thy, F.lit("."), base, F.lit(".simps")))
            .when(m == 2, F.concat(thy, F.lit("."), base, F.lit("_class.x")))
            .otherwise(base))


def _lemma_name(orderkey):
    suffix = F.when(orderkey % 7 == 0, F.lit(".simps")).when(orderkey % 5 == 0, F.lit("(2)")).otherwise(F.lit(""))
    return F.concat(F.lit("o"), orderkey.cast("string"), suffix)


def order_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """templates(theory_file, lemma_name, lemma_object, symbols, template) per order."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", _symbol(F.col("l_partkey"), F.col("l_linenumber")).alias("symbol"))
    syms = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "symbol"))).alias("s"))
    t = o.join(syms, o.o_orderkey == syms.l_orderkey, "left")
    theory = F.concat(F.lit("Thy"), F.col("o_custkey").cast("string"))
    return t.select(
        theory.alias("theory_file"),
        F.concat(theory, F.lit("."), _lemma_name(F.col("o_orderkey"))).alias("lemma_name"),
        F.concat(F.lit("?"), F.col("o_orderpriority"), F.lit(" = "), F.col("o_orderstatus")).alias("lemma_object"),
        F.array_distinct(F.coalesce(F.col("s.symbol"), F.array().cast("array<string>"))).alias("symbols"),
        F.concat(F.lit("?H1 ("), F.col("o_orderpriority"), F.lit(")\n= ?H2")).alias("template"),
    )


def order_theorems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """theorems(theory_file, lemma_name, stmt): the source statements of finished orders."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    name = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    return o.select(F.concat(F.lit("Thy"), F.col("o_custkey").cast("string")).alias("theory_file"),
                    name.alias("lemma_name"),
                    F.concat(F.lit("lemma "), name, F.lit(': "'), F.col("o_orderpriority"), F.lit('"')).alias("stmt"))


def part_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """definitions(def_key, theory_file, pos, def_name, def_stmt) per part, four parts to a
    theory; every tenth part is defined twice under one key."""
    from quire.functions.text import qualified_def_key

    p = table(spark, sf_dir, "part")
    thy = _part_theory(F.col("p_partkey"))
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    times = F.when(F.col("p_partkey") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    again = F.when(F.col("again") == 1, F.lit(" again")).otherwise(F.lit(""))
    p = p.withColumn("again", F.explode(times))
    return p.select(qualified_def_key(thy, name).alias("def_key"), thy.alias("theory_file"),
                    (F.col("p_partkey") * 2 + F.col("again")).alias("pos"), name.alias("def_name"),
                    F.concat(F.lit("definition "), name, F.lit(' where "'), F.col("p_name"), again, F.lit('"')).alias("def_stmt"))


def customer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """runs(theory_file): the results that theories delivered; every tenth customer's twice."""
    c = table(spark, sf_dir, "customer")
    times = F.when(F.col("c_custkey") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return c.select(F.concat(F.lit("Thy"), F.col("c_custkey").cast("string")).alias("theory_file"), F.explode(times).alias("again")).drop("again")


def part_symbol_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol_types(symbol, type, arity): every part symbol (one-dot form) with its type
    and an arity of ``p_size mod 3``."""
    p = table(spark, sf_dir, "part")
    sym = F.concat(_part_theory(F.col("p_partkey")), F.lit(".p"), F.col("p_partkey").cast("string"))
    return p.select(sym.alias("symbol"), F.col("p_type").alias("type"), (F.col("p_size") % 3).alias("arity"))


# --- prompt inputs: per order, the names / types / definitions of its parts ----

def order_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """examples(row_id, symbols, types, defs, template, lemma_object, output_key) per
    order: its parts' names, types and one-line definitions in line order; every
    third order has one type fewer than symbols (zip stops at the shorter list);
    even orders ask for the template as output, odd ones for the statement."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    j = li.join(p, li.l_partkey == p.p_partkey)
    items = j.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "p_name", "p_type",
        F.concat(F.lit("definition "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" = "), F.col("p_brand")).alias("d"),
    ))).alias("it"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    t = o.join(items, o.o_orderkey == items.l_orderkey, "left").withColumn("it", F.coalesce("it", F.array().cast(items.schema["it"].dataType)))
    types = F.col("it.p_type")
    return t.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("it.p_name").alias("symbols"),
        F.when(F.col("o_orderkey") % 3 == 0, F.slice(types, 1, F.greatest(F.size(types) - 1, F.lit(0)))).otherwise(types).alias("types"),
        F.col("it.d").alias("defs"),
        F.concat(F.lit("?H1 ("), F.col("o_orderpriority"), F.lit(")")).alias("template"),
        F.concat(F.col("o_orderstatus"), F.lit(" "), F.col("o_orderpriority")).alias("lemma_object"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("template")).otherwise(F.lit("lemma_object")).alias("output_key"),
    )


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, prompt, reply): every user turn with the assistant turn after it."""
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return u.join(a, ["conv_id", "turn"])


# --- terms from `part`, fillers from `nation` / `region` -------------------------
# Every part gives one small statement ``c1 x = c2 ...`` over two constants named
# after the words of its name; the part key picks the shape (under a binder, under
# Trueprop, under a premise, as a meta-equality; ``undefined`` as a side or as an
# argument; one constant at two types) and the part size the arity of the second
# constant, which for some takes a function.

def part_terms(spark: SparkSession, sf_dir: str, spread: bool = False, shares: bool = False) -> DataFrame:
    """terms(term_id, name, tokens), a row a part.  With ``spread`` the parts are dealt over the cores first: the
    table is small on disk, which makes few tasks of its scan, but each row is much work.  With ``shares`` that is
    done by ``table_shares``, without a shuffle."""
    from quire.functions.terms import tok

    p = table_shares(spark, sf_dir, "part") if shares else table(spark, sf_dir, "part")
    if spread:
        p = p.repartition("p_partkey")
    w1 = F.substring_index("p_name", " ", 1)
    w2 = F.substring_index("p_name", " ", -1)
    ar = F.col("p_size") % 3
    m, k = F.col("p_partkey") % 4, F.col("p_partkey") % 16
    app = tok("app", None, None)
    t2 = (F.when((ar == 1) & (k == 9), F.lit("((nat => nat) => nat) => nat"))
          .when(ar == 0, F.lit("nat")).when(ar == 1, F.lit("nat => nat")).otherwise(F.lit("nat => nat => nat")))
    c1 = tok("const", F.concat(F.lit("Part."), w1), "nat => nat")
    c2 = tok("const", F.concat(F.lit("Part."), F.when(k == 5, w1).otherwise(w2)), t2)
    x = F.when(m == 0, tok("bound", "0", "nat")).otherwise(tok("var", "x", "nat"))
    y = tok("var", "y", "nat")
    eq = tok("const", F.when(m == 2, F.lit("Pure.eq")).otherwise(F.lit("HOL.eq")), "nat => nat => bool")
    rhs = (F.when(F.col("p_partkey") % 8 == 3, F.array(tok("const", "HOL.undefined", "nat")))
           .when(ar == 0, F.array(c2)).when(ar == 1, F.array(app, c2, x)).otherwise(F.array(app, app, c2, x, y)))
    undefined = tok("const", "HOL.undefined", "nat")
    body = F.concat(F.array(app, app, eq, app, c1, F.when(k == 13, undefined).otherwise(x)), rhs)
    trueprop = tok("const", "HOL.Trueprop", "bool => prop")
    prefix = (F.when(m == 0, F.array(app, trueprop, app, tok("const", "HOL.All", "(nat => bool) => bool"), tok("abs", "x", "nat")))
              .when(m == 2, F.array().cast(f"array<{_TOKEN}>"))
              .when(k == 7, F.array(app, app, tok("const", "Pure.imp", "prop => prop => prop"), app, trueprop, tok("var", "p", "bool"), app, trueprop))
              .otherwise(F.array(app, trueprop)))
    name = F.concat(F.col("p_brand"), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"),
                    F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 13 == 0, F.lit("_def")).otherwise(F.lit("")))
    return p.select(F.col("p_partkey").alias("term_id"), name.alias("name"), F.concat(prefix, body).alias("tokens"))


_TOKEN = "struct<kind:string,name:string,type:string>"


def nation_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbols(symbol, type, arity, sym_pos): nations as fillers, arity = key mod 3."""
    n = table(spark, sf_dir, "nation")
    ar = F.col("n_nationkey") % 3
    typ = F.when(ar == 0, F.lit("nat")).when(ar == 1, F.lit("nat => nat")).otherwise(F.lit("nat => nat => nat"))
    return n.select(F.concat(F.lit("Nation."), F.replace("n_name", F.lit(" "), F.lit("_"))).alias("symbol"), typ.alias("type"),
                    ar.cast("int").alias("arity"), F.col("n_nationkey").cast("long").alias("sym_pos"))


def region_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbols(symbol, type, arity, sym_pos): regions as fillers, arity = key mod 3."""
    r = table(spark, sf_dir, "region")
    ar = F.col("r_regionkey") % 3
    typ = F.when(ar == 0, F.lit("nat")).when(ar == 1, F.lit("nat => nat")).otherwise(F.lit("nat => nat => nat"))
    return r.select(F.concat(F.lit("Region."), F.replace("r_name", F.lit(" "), F.lit("_"))).alias("symbol"), typ.alias("type"),
                    ar.cast("int").alias("arity"), F.col("r_regionkey").cast("long").alias("sym_pos"))
