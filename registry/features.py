"""Fingerprints, per-structure features, node and edge tables, neighbourhood aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from doseframe import schemas as S
from doseframe.operators import featurize as K, graph as G, joins as J, profile as P
from doseframe.session import scratch_path
from registry.base import query, r, rounded
from registry.inputs import spread, table


def _bits_sql(source: str, key: str, text: str) -> str:
    return f"""with t as (select {key}, list_filter(string_split_regex({text}, '\\s+'), lambda x: x <> '') as w from {source}),
 g as (select {key}, list_concat(w, list_concat(
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as g from t),
 b as (select {key}, list_sort(list_distinct(list_transform(g, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT % 2048))) as bits from g)
 select {key}, len(bits)::INTEGER as n_bits, array_to_string(bits, ',') as bits from b"""


def _bits(df, key, text):
    out = K.with_fingerprint(df, text)
    return out.select(key, F.size("bits").alias("n_bits"), F.array_join(F.col("bits").cast("array<string>"), ",").alias("bits"))


@query("fingerprint_documents", _bits_sql("documents", "doc_id", "text"))
def fingerprint_documents(spark, d):
    return _bits(spread(table(spark, d, "documents")), "doc_id", "text")


@query("fingerprint_parts", _bits_sql("part", "p_partkey", "p_name || ' ' || p_brand || ' ' || p_type"))
def fingerprint_parts(spark, d):
    part = table(spark, d, "part").withColumn("text", F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return _bits(part, "p_partkey", "text")


# The function refuses names with 'ring', so those have no features.
@query("featurized_parts", """select p_partkey, case when p_name not like '%ring%' then len(string_split(p_name, ' '))::INTEGER end as words,
 case when p_name not like '%ring%' then length(p_name)::INTEGER end as letters from part""")
def featurized_parts(spark, d):
    def measure(name: str) -> dict:
        if "ring" in name:
            raise ValueError("cannot read this structure")
        return {"words": len(name.split(" ")), "letters": len(name)}

    out = K.featurize(table(spark, d, "part"), "p_name", measure, "words int, letters int")
    return out.select("p_partkey", "words", "letters")


@query("feature_store", "select p_name, length(p_name)::INTEGER as letters from part group by 1, 2")
def feature_store(spark, d):
    """The store first holds the small parts, then only the missing names are computed."""
    def letters(name: str) -> dict:
        return {"letters": len(name)}

    part, path = table(spark, d, "part"), scratch_path(spark, "store")
    K.refresh_features(part.where("p_size < 10"), "p_name", letters, "letters int", path)
    return K.refresh_features(part, "p_name", letters, "letters int", path)


@query("feature_lookup", """select p_partkey, l.letters from part join (
 select p_name, length(p_name)::INTEGER as letters from part where p_size = 1 group by 1, 2) l using (p_name)""")
def feature_lookup(spark, d):
    part = table(spark, d, "part")
    stored = part.where("p_size = 1").select("p_name", F.length("p_name").alias("letters"), F.lit(0).alias("p_size")).distinct()
    return J.lookup(part, stored, "p_name").select("p_partkey", "letters")


TOKENS = r"""tok as (select p_partkey, regexp_extract_all(p_name || '|' || p_brand, '(\[[^\]]+\]|Br|Cl|%\d{2}|.)', 1) as w from part)"""


def _structures(spark, d):
    return table(spark, d, "part").withColumn("text", F.concat_ws("|", "p_name", "p_brand"))


@query("token_nodes", f"""with {TOKENS} select p_partkey as mol_id, (unnest(range(1, len(w) + 1)) - 1)::INTEGER as atom_idx, unnest(w) as token from tok""")
def token_nodes(spark, d):
    return K.token_nodes(_structures(spark, d), "p_partkey", "text")


@query("token_edges", f"""with {TOKENS}, e as (select p_partkey as mol_id, unnest(range(1, len(w)))::INTEGER as i from tok)
 select mol_id, i - 1 as src, i as dst from e union all select mol_id, i, i - 1 from e""")
def token_edges(spark, d):
    return K.token_edges(_structures(spark, d), "p_partkey", "text")


@query("distinct_graphs", f"""with {TOKENS}, f as (select min(p_partkey) as mol_id, w from tok group by w)
 select mol_id, len(w)::BIGINT as atoms, (2 * (len(w) - 1))::BIGINT as arcs from f""")
def distinct_graphs(spark, d):
    one = K.distinct_structures(_structures(spark, d).select("p_partkey", "text"), "text", ["p_partkey"])
    arcs = K.token_edges(one, "p_partkey", "text").groupBy("mol_id").agg(F.count("*").alias("arcs"))
    return G.molecule_sizes(K.token_nodes(one, "p_partkey", "text")).join(arcs, "mol_id", "left").select(
        "mol_id", "atoms", F.coalesce("arcs", F.lit(0)).cast("bigint").alias("arcs")
    )


WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"


@query("large_molecules", f"""with s as (select len({WORDS}) as n from documents) select count(*) filter (n > 0) as molecules,
 count(*) filter (n >= 200) as atoms_ge_200, count(*) filter (n >= 300) as atoms_ge_300, count(*) filter (n >= 400) as atoms_ge_400 from s""")
def large_molecules(spark, d):
    docs = table(spark, d, "documents")
    return G.large_molecules(K.token_nodes(docs, "doc_id", "text", K.H.word_tokens(F.col("text"))))


@query("molecule_size_histogram", f"""with s0 as (select len({WORDS})::DOUBLE as x from documents), w0 as (select x from s0 where x > 0),
 s as (select min(x) as lo, max(x) as hi from w0),
 b as (select least(floor((x - lo) / ((hi - lo) / 20)), 19)::BIGINT as bin, count(*) as n from w0, s group by 1)
 select g.bin::BIGINT as bin, {r('lo + (hi - lo) / 20 * g.bin', 4)} as low, {r('lo + (hi - lo) / 20 * (g.bin + 1)', 4)} as high,
  coalesce(n, 0)::BIGINT as count from s, (select unnest(range(0, 20)) as bin) g left join b on b.bin = g.bin""")
def molecule_size_histogram(spark, d):
    docs = table(spark, d, "documents")
    return rounded(G.size_distribution(K.token_nodes(docs, "doc_id", "text", K.H.word_tokens(F.col("text"))), 20), 4)


# Events as atoms: attributes by remainder, with values outside every category among them.
NUMBERS = [1, 5, 6, 7, 8, 9, 14, 15, 16, 17, 34, 35, 53, 99]
HYBRID = [*S.HYBRIDIZATIONS, "OTHER"]
CHIRAL = [*S.CHIRAL_TAGS, "CHI_OTHER"]
BONDS = [*S.BOND_TYPES, "DATIVE"]
STEREO = [*S.BOND_STEREO, "STEREOANY"]


def _hot_sql(value: str, cats: list) -> str:
    return ", ".join(f"coalesce(({value} = {c!r})::INTEGER, 0)::DOUBLE" for c in cats)


def _pick(values: list, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _list_sql(values: list, index: str) -> str:
    return f"{values!r}[({index}) % {len(values)} + 1]"


@query("node_features", f"""with a as (select user_id as mol_id, event_id as i, {_list_sql(NUMBERS, 'event_id')} as z,
   {_list_sql(HYBRID, 'event_id')} as hy, {_list_sql(CHIRAL, 'event_id')} as ch from events),
 f as (select mol_id, [{_hot_sql('z', S.ATOMIC_NUMBERS)}, {_hot_sql('hy', S.HYBRIDIZATIONS)}, {_hot_sql('ch', S.CHIRAL_TAGS)},
   i % 5 / 4.0::DOUBLE, (i % 9 - 4 + 4) / 8.0::DOUBLE, i % 4 / 4.0::DOUBLE, i % 7 / 8.0::DOUBLE, i % 3 / 2.0::DOUBLE,
   (i % 2 = 0)::INTEGER::DOUBLE, (i % 3 = 0)::INTEGER::DOUBLE] as v from a),
 u as (select mol_id, unnest(range(0, 28)) as pos, unnest(v) as x from f)
 select mol_id, pos::INTEGER as pos, {r('sum(x)')} as total from u group by 1, 2""")
def node_features(spark, d):
    i = F.col("event_id")
    atoms = table(spark, d, "events").select(
        F.col("user_id").alias("mol_id"), i.alias("atom_idx"), _pick(NUMBERS, i).alias("atomic_num"),
        _pick(HYBRID, i).alias("hybridization"), _pick(CHIRAL, i).alias("chiral_tag"), (i % 5).alias("degree"),
        (i % 9 - 4).alias("formal_charge"), (i % 4).alias("num_hs"), (i % 7).alias("total_valence"),
        (i % 3).alias("num_radical"), (i % 2 == 0).alias("is_aromatic"), (i % 3 == 0).alias("is_in_ring"),
    )
    pooled = G.readout(G.node_features(atoms), 28, "add")
    return rounded(pooled.select("mol_id", F.posexplode("feats").alias("pos", "total")))


@query("edge_features", f"""with b as (select o_custkey as mol_id, o_orderkey as u, o_orderkey + 1 as v, {_list_sql(BONDS, 'o_orderkey')} as bt,
   {_list_sql(STEREO, 'o_orderkey')} as st, o_orderkey % 2 = 0 as conj, o_orderkey % 3 = 0 as ring from orders),
 f as (select *, array_to_string([{_hot_sql('bt', S.BOND_TYPES)}, {_hot_sql('st', S.BOND_STEREO)}, conj::INTEGER::DOUBLE, ring::INTEGER::DOUBLE]::INTEGER[], '') as feats from b)
 select mol_id, u as src, v as dst, feats from f union all select mol_id, v, u, feats from f""")
def edge_features(spark, d):
    i = F.col("o_orderkey")
    bonds = table(spark, d, "orders").select(
        F.col("o_custkey").alias("mol_id"), i.alias("begin_idx"), (i + 1).alias("end_idx"), _pick(BONDS, i).alias("bond_type"),
        _pick(STEREO, i).alias("stereo"), (i % 2 == 0).alias("is_conjugated"), (i % 3 == 0).alias("is_in_ring"),
    )
    return G.edge_features(bonds).withColumn("feats", F.array_join(F.col("feats").cast("array<int>").cast("array<string>"), ""))


# Embeddings as atoms of ten-atom chains; the edge vector is constant and comes from the source's label.
WIDTH = 64


def chain(spark, d, edge_feats=True):
    rows = table(spark, d, "embeddings")
    mol, at = F.floor(F.col("vec_id") / 10).cast("bigint"), (F.col("vec_id") % 10).cast("int")
    nodes = rows.select(mol.alias("mol_id"), at.alias("atom_idx"), F.col("embedding").cast("array<double>").alias("feats"))
    weight = (F.col("label") - 5) / 50.0
    arcs = rows.select(
        mol.alias("mol_id"), at.alias("src"), F.explode(F.array(at - 1, at + 1)).alias("dst"),
        *([F.array_repeat(weight, WIDTH).alias("feats")] if edge_feats else []),
    )
    # Both ends must exist: the last chain may be short.
    ends = rows.select(mol.alias("mol_id"), at.alias("dst"))
    arcs = arcs.join(ends, ["mol_id", "dst"]).select("mol_id", "src", "dst", *(["feats"] if edge_feats else []))
    return nodes, arcs


CHAIN = """n as (select vec_id // 10 as mol_id, (vec_id % 10)::INTEGER as atom_idx, unnest(range(0, 64))::INTEGER as pos,
   unnest(embedding)::DOUBLE as x, (label - 5) / 50.0::DOUBLE as w from embeddings),
 m as (select d.mol_id, d.atom_idx, d.pos, s.x, greatest(s.x + s.w, 0) as msg
   from n d join n s on d.mol_id = s.mol_id and abs(d.atom_idx - s.atom_idx) = 1 and d.pos = s.pos)"""


def _cells(nodes):
    return rounded(nodes.select("mol_id", "atom_idx", F.posexplode("feats").alias("pos", "value")))


@query("neighbour_sum", f"""with {CHAIN}, a as (select mol_id, atom_idx, pos, sum(msg) as s from m group by all)
 select mol_id, atom_idx, pos, {r('greatest(x + coalesce(s, 0), 0) + x')} as value from n left join a using (mol_id, atom_idx, pos)""")
def neighbour_sum(spark, d):
    nodes, arcs = chain(spark, d)
    return _cells(G.neighbour_aggregate(nodes, arcs, WIDTH, "sum", residual=True))


for _how, _fn in (("max", "max"), ("min", "min"), ("mean", "avg"), ("std", "stddev_pop")):
    @query(f"neighbour_{_how}", f"""with {CHAIN}, a as (select mol_id, atom_idx, pos, {_fn}(x) as s from m group by all)
     select mol_id, atom_idx, pos, {r('coalesce(s, 0)')} as value from n left join a using (mol_id, atom_idx, pos)""")
    def neighbour_other(spark, d, how=_how):
        nodes, arcs = chain(spark, d, edge_feats=False)
        return _cells(G.neighbour_aggregate(nodes, arcs, WIDTH, how, own=False))


# Three embeddings side by side: 192 elements, as many as the hidden layer of the wide models.
WIDE = CHAIN.replace("unnest(range(0, 64))::INTEGER as pos", "unnest(range(0, 192))::INTEGER as pos").replace(
    "unnest(embedding)::DOUBLE as x", "unnest(embedding || list_transform(embedding, lambda v: -v) || list_transform(embedding, lambda v: 2 * v))::DOUBLE as x")


@query("neighbour_wide", f"""with {WIDE}, a as (select mol_id, atom_idx, pos, sum(msg) as s from m group by all)
 select mol_id, atom_idx, pos, {r('greatest(x + coalesce(s, 0), 0) + x')} as value from n left join a using (mol_id, atom_idx, pos)""")
def neighbour_wide(spark, d):
    nodes, arcs = chain(spark, d)
    tripled = F.concat("feats", F.transform("feats", lambda v: -v), F.transform("feats", lambda v: v * 2))
    arcs = arcs.withColumn("feats", F.concat("feats", "feats", "feats"))
    return _cells(G.neighbour_aggregate(nodes.withColumn("feats", tripled), arcs, 3 * WIDTH, "sum", residual=True))


@query("neighbour_two_rounds", f"""with {CHAIN}, a as (select mol_id, atom_idx, pos, sum(msg) as s from m group by all),
 n2 as (select mol_id, atom_idx, pos, x + coalesce(s, 0) as x, w from n left join a using (mol_id, atom_idx, pos)),
 a2 as (select d.mol_id, d.atom_idx, d.pos, sum(greatest(s.x + s.w, 0)) as s
   from n2 d join n2 s on d.mol_id = s.mol_id and abs(d.atom_idx - s.atom_idx) = 1 and d.pos = s.pos group by all)
 select mol_id, atom_idx, pos, {r('x + coalesce(s, 0)')} as value from n2 left join a2 using (mol_id, atom_idx, pos)""")
def neighbour_two_rounds(spark, d):
    nodes, arcs = chain(spark, d)
    return _cells(G.rounds(nodes, arcs, WIDTH, 2))


@query("degree_normalized", f"""with {CHAIN}, dg as (select mol_id, atom_idx, pos, 1 + count(*) as g from m group by all),
 k as (select n.*, 1 / sqrt(coalesce(g, 1)) as c from n left join dg using (mol_id, atom_idx, pos)),
 a as (select d.mol_id, d.atom_idx, d.pos, sum(s.x * s.c) as s from k d join k s
   on d.mol_id = s.mol_id and abs(d.atom_idx - s.atom_idx) = 1 and d.pos = s.pos group by all)
 select mol_id, atom_idx, pos, {r('c * (x * c + coalesce(s, 0))')} as value from k left join a using (mol_id, atom_idx, pos)""")
def degree_normalized(spark, d):
    nodes, arcs = chain(spark, d, edge_feats=False)
    return _cells(G.degree_normalized(nodes, arcs, WIDTH))


@query("virtual_node", f"""with {CHAIN}, a as (select mol_id, atom_idx, pos, sum(x) as s from m group by all),
 v as (select mol_id, pos, sum(x) as s from n group by all)
 select mol_id, atom_idx, pos, {r('x + coalesce(s, 0)')} as value from n left join a using (mol_id, atom_idx, pos)
 union all select mol_id, -1, pos, {r('s')} from v""")
def virtual_node(spark, d):
    nodes, arcs = G.with_virtual_node(*chain(spark, d, edge_feats=False), WIDTH)
    return _cells(G.neighbour_aggregate(nodes, arcs, WIDTH, "sum", hubs=True))


PROJECTION = [[((row * 7 + i * 3) % 5 - 2) / 4.0 for i in range(WIDTH)] for row in range(4)]


@query("projected_nodes", f"""with {CHAIN}, p as (select mol_id, atom_idx, k, sum(x * ((k * 7 + pos * 3) % 5 - 2) / 4.0::DOUBLE) + 0.1::DOUBLE as y
   from n, (select unnest([0, 1, 2, 3])::INTEGER as k) group by all)
 select mol_id, atom_idx, k as pos, {r('greatest(y, 0)')} as value from p""")
def projected_nodes(spark, d):
    nodes, _ = chain(spark, d)
    return _cells(G.projected(nodes, PROJECTION, [0.1] * 4, activate=True))


@query("readout_mean", f"with {CHAIN} select mol_id, pos, {r('avg(x)')} as value from n group by 1, 2")
def readout_mean(spark, d):
    nodes, _ = chain(spark, d)
    return rounded(G.readout(nodes, WIDTH, "mean").select("mol_id", F.posexplode("feats").alias("pos", "value")))


@query("readout_min_max", f"""with {CHAIN} select mol_id, pos, {r('min(x)')} as value from n group by 1, 2
 union all select mol_id, pos + 64, {r('max(x)')} from n group by 1, 2""")
def readout_min_max(spark, d):
    nodes, _ = chain(spark, d)
    return rounded(G.readout(nodes, WIDTH, "min+max").select("mol_id", F.posexplode("feats").alias("pos", "value")))


@query("vector_nan", """select 'as stored' as vectors, coalesce(bool_or(len(list_filter(embedding, lambda x: isnan(x))) > 0), false) as has_nan from embeddings
 union all select 'with gaps', count(*) filter (label = 3) > 0 from embeddings""")
def vector_nan(spark, d):
    rows = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    gaps = rows.withColumn("v", F.when(F.col("label") == 3, F.array(F.lit(float("nan")))).otherwise(F.col("v")))
    return P.any_nan(rows, "v").withColumn("vectors", F.lit("as stored")).unionByName(
        P.any_nan(gaps, "v").withColumn("vectors", F.lit("with gaps"))
    )
