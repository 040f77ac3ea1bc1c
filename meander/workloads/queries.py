"""The registered queries: one per operator, over the whole of the supplied tables.

Lists come out as rows or joined text, so that results compare with SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meander.functions import text as X
from meander.operators import adjacency as A, alias, embedding as E, index as I, naming as N
from meander.operators import padding as P, transition as T, walk as W
from meander.operators.lists import hold_lists, open_lists, save_lists
from meander.params import Params, SEPARATOR
from meander.plans import commands as C
from meander.scratch import Scratch
from meander.sources import readers as R, writers as Wr
from meander.sources.rejects import rejected
from meander.workloads import graphs as G

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEED = 7
DEGREE = 50
WALKS = 2
STEPS = 4
LONG_STEPS = Params().walk_length


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def as_text(walks: DataFrame) -> DataFrame:
    return walks.select("walk_no", "start", X.joined(F.col("path"), " ").alias("path_text"),
                        X.joined(F.col("feats"), " ").alias("feats_text"))


def _adj(spark: SparkSession, sf_dir: str, graph: str, degree: int = DEGREE,
         scratch: Scratch | None = None) -> DataFrame:
    return G.indexed(spark, sf_dir, graph, scratch or Scratch(spark)).adjacency(degree)


def _written_adj(spark: SparkSession, sf_dir: str, graph: str, degree: int) -> DataFrame:
    """Lists for operators that read them more than once."""
    scratch = Scratch(spark)
    return scratch.cut(_adj(spark, sf_dir, graph, degree, scratch), "adj")


def _walks(spark: SparkSession, sf_dir: str, graph: str, p: float = 1.0, q: float = 1.0,
           steps: int = STEPS, walks: int = WALKS, every: int = 8, degree: int = DEGREE, method: str = "sums") -> DataFrame:
    scratch = Scratch(spark)
    adj = _adj(spark, sf_dir, graph, degree, scratch)
    return W.random_walk(adj, steps, walks, p, q, SEED, checkpoint_every=every, scratch=scratch, method=method)


# Text sources.  The lines are made from the tables, in every shape a line may
# have, written as text and read back.

def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line per sale; its line number decides its shape."""
    c, p = G._named("c", "o_custkey"), G._named("p", "l_partkey")
    sales = G._sales(spark, sf_dir)
    n = F.col("l_linenumber")
    shape = (F.when(n == 1, F.concat(c, F.lit(" "), p))
              .when(n == 2, F.concat(F.lit("  "), c, F.lit("\t"), p, F.lit(" ")))
              .when(n == 3, F.concat(c, F.lit(" x  y "), p))
              .when(n == 4, F.concat(c, F.lit(" ")))
              .when(n == 5, F.lit(" \t "))
              .when(n == 6, F.lit(""))
              .otherwise(F.concat(c, F.lit("   "), p)))
    return sales.select(shape.alias("value"))


def feature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = G.table(spark, sf_dir, "part")
    line = F.concat_ws(" ", G._named("p", "p_partkey"), "p_name", "p_type",
                       F.when(F.col("p_size") > 25, F.col("p_brand")))
    return part.select(line.alias("value"))


def padded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded edges of lines: with a weight, without, with a bad one, without features."""
    sep = F.lit(SEPARATOR)
    line = G.table(spark, sf_dir, "lineitem")
    s, p = G._named("s", "l_suppkey"), G._named("p", "l_partkey")
    n = F.col("l_linenumber")
    src = F.when(n == 3, s).when(n == 4, F.concat(s, sep)).when(n == 5, F.concat(sep, s)).otherwise(
        F.concat(s, sep, F.lit("x"), sep, F.col("l_returnflag")))
    dst = F.when(n == 3, p).otherwise(F.concat(p, sep, F.col("l_linestatus")))
    weight = (F.when(n == 1, F.col("l_quantity").cast("int").cast("string"))
               .when(n == 2, F.lit("many")).when(n == 6, F.lit("0")))
    return line.select(F.concat_ws(" ", src, dst, weight).alias("value"))


@query
def read_edges(spark, sf_dir):
    """O-01"""
    return R.read_edges(spark, Scratch(spark).text(edge_lines(spark, sf_dir)))


@query
def read_features(spark, sf_dir):
    """O-02"""
    return R.read_features(spark, Scratch(spark).text(feature_lines(spark, sf_dir)))


@query
def read_padded(spark, sf_dir):
    """O-03"""
    return R.read_padded(spark, Scratch(spark).text(padded_text(spark, sf_dir)))


@query
def read_node2feat(spark, sf_dir):
    """O-04"""
    lines = Wr.node2feat_lines(G.customer_features(spark, sf_dir))
    return R.read_node2feat(spark, Scratch(spark).text(lines))


@query
def read_corpus(spark, sf_dir):
    """O-05: the words of every line of every document."""
    lines = G.table(spark, sf_dir, "documents").select(
        F.explode(F.split("text", "\n")).alias("value"))
    corpus = R.read_corpus(spark, Scratch(spark).text(lines))
    return corpus.select(F.size("tokens").alias("n_tokens"),
                         X.joined(F.col("tokens"), " ").alias("tokens_text"))


@query
def read_feat_corpus(spark, sf_dir):
    """O-06: feature walks as written, with # for the separator."""
    sales = G._sales(spark, sf_dir).select(
        F.concat_ws("#", G._named("c", "o_custkey"), F.col("l_orderkey").cast("string"),
                    F.concat_ws(" ", G._named("p", "l_partkey"), G._named("s", "l_suppkey")))
        .alias("value"))
    corpus = R.read_feat_corpus(spark, Scratch(spark).text(sales), "#")
    return corpus.select(X.joined(F.col("tokens"), " ").alias("tokens_text"))


@query
def read_indexed(spark, sf_dir):
    """O-08: ids in place of names; the lines of one return flag have no number."""
    key = F.when(F.col("l_returnflag") == "A", F.lit("none")).otherwise(
        F.col("l_suppkey").cast("string"))
    lines = G.table(spark, sf_dir, "lineitem").select(F.concat_ws(
        " ", F.concat(key, F.lit(SEPARATOR), F.col("l_returnflag")),
        F.concat(F.col("l_partkey").cast("string"), F.lit(SEPARATOR), F.col("l_linestatus")),
        F.col("l_linenumber").cast("string")).alias("value"))
    return R.read_indexed(spark, Scratch(spark).text(lines))


@query
def drop_malformed(spark, sf_dir):
    """O-09"""
    kept = P.drop_malformed(edge_lines(spark, sf_dir))
    return kept.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query
def rejected_lines(spark, sf_dir):
    """O-09: the dropped lines of two sources, by reason."""
    edges = rejected(edge_lines(spark, sf_dir), "edges").withColumn("kind", F.lit("edges"))
    padded = rejected(padded_text(spark, sf_dir), "padded").withColumn("kind", F.lit("padded"))
    return edges.unionByName(padded).groupBy("kind", "reason", "value").agg(F.count(F.lit(1)).alias("n"))


@query
def edge_weight(spark, sf_dir):
    """O-11: the last word of every document line as a number, or 1."""
    lines = G.table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value"))
    return lines.select("doc_id", "pos",
                        X.number_or(X.last_token(F.col("value")), 1.0).alias("weight"))


# Padding, ids, adjacency.

@query
def pad_edges(spark, sf_dir):
    """O-10, O-15, O-33, O-40"""
    return Wr.padded_lines(G.customer_part(spark, sf_dir).padded(weighted=False))


@query
def pad_edges_multi(spark, sf_dir):
    """O-15 with several features per vertex and vertices without one."""
    lines = G.table(spark, sf_dir, "lineitem").select(
        G._named("s", "l_suppkey").alias("src"), G._named("p", "l_partkey").alias("dst"),
        F.lit(1.0).alias("weight"), "l_returnflag", "l_linestatus")
    one = lines.where("l_linestatus = 'O'").select(
        F.col("src").alias("node"), F.col("l_returnflag").alias("feat"))
    two = lines.where("l_returnflag = 'R'").select(
        F.col("dst").alias("node"), F.col("l_linestatus").alias("feat"))
    return P.pad_edges(lines, one, two)


@query
def node2feat(spark, sf_dir):
    """O-14"""
    return P.node2feat(G.user_key(spark, sf_dir).padded(), "both")


@query
def node2feat_src(spark, sf_dir):
    """O-14 for the sources of edges only."""
    return P.node2feat(G.tripartite(spark, sf_dir).padded(), "src")


@query
def node2id(spark, sf_dir):
    """O-22, O-33"""
    return I.node_index(G.tripartite(spark, sf_dir).padded(), Scratch(spark))


@query
def index_edges(spark, sf_dir):
    """O-16"""
    return G.indexed(spark, sf_dir, "supplier_part", Scratch(spark)).edges


@query
def half_indexed_text(spark, sf_dir):
    """O-42"""
    graph = G.indexed(spark, sf_dir, "supplier_part", Scratch(spark))
    return Wr.half_indexed_lines(I.half_indexed(graph.padded, graph.node2id))


@query
def neighbour_edges(spark, sf_dir):
    """O-23 as rows, which need no cap."""
    return A.neighbour_edges(G.indexed(spark, sf_dir, "customer_part", Scratch(spark)).edges)


@query
def adjacency(spark, sf_dir):
    """O-23 as lists, capped."""
    rows = _adj(spark, sf_dir, "customer_part")
    return rows.select("id", F.size("nbrs").alias("n"), X.joined(F.col("nbrs.nbr"), " ").alias("nbrs"),
                       X.joined(F.col("nbrs.feat"), " ").alias("feats"))


@query
def adjacency_directed(spark, sf_dir):
    """O-23 in one direction, unweighted."""
    graph = G.indexed(spark, sf_dir, "tripartite", Scratch(spark))
    return A.adj_edges(graph.adjacency(DEGREE, directed=True, weighted=False))


@query
def degree_cap(spark, sf_dir):
    """O-24"""
    graph = G.indexed(spark, sf_dir, "supplier_part", Scratch(spark))
    return A.degree_cap(A.neighbour_edges(graph.edges), DEGREE)


@query
def adj_edges(spark, sf_dir):
    """O-25"""
    return A.adj_edges(_adj(spark, sf_dir, "user_key", DEGREE))


@query
def triplets(spark, sf_dir):
    """O-19"""
    rows = A.triplets(_written_adj(spark, sf_dir, "user_key", DEGREE))
    return rows.select("src_id", "dst_id", "weight", "dst_feat",
                       X.joined(F.col("src_nbrs.nbr"), " ").alias("src_nbrs"),
                       X.joined(F.col("dst_nbrs.nbr"), " ").alias("dst_nbrs"))


# Transitions and draws.

@query
def transition1(spark, sf_dir):
    """O-28"""
    return T.transition1(_adj(spark, sf_dir, "customer_part"))


@query
def transition2(spark, sf_dir):
    """O-29"""
    scratch = Scratch(spark)
    lists = T.transition_lists(_written_adj(spark, sf_dir, "tripartite", DEGREE), 0.25, 4.0, scratch)
    # One row per pair of vertices with its whole list; 40 bits of each probability.
    probs = F.transform("next", lambda e: F.concat(e["nbr"].cast("string"), F.lit(":"), F.floor(e["prob"] * (1 << 40)).cast("string")))
    return lists.select("prev", "cur", F.size("next").alias("n"), F.array_join(probs, " ").alias("probs"))


@query
def alias_tables(spark, sf_dir):
    """O-28 as alias tables."""
    return alias.alias_tables(_adj(spark, sf_dir, "customer_part"))


@query
def alias_draw(spark, sf_dir):
    """O-30 by alias tables."""
    return alias.alias_draw(alias.alias_tables(_adj(spark, sf_dir, "customer_part")), SEED, 3)


@query
def weighted_draw(spark, sf_dir):
    """O-30"""
    return W.weighted_draw(_adj(spark, sf_dir, "customer_part"), SEED, 3)


# Walks.

@query
def walk_start(spark, sf_dir):
    """O-31"""
    layout = W.lay_out(_adj(spark, sf_dir, "customer_part"))
    return as_text(W.as_walks(W.walk_start(layout, WALKS, SEED), layout, 1))


@query
def walk_step(spark, sf_dir):
    """O-26"""
    scratch = Scratch(spark)
    lists = hold_lists(_adj(spark, sf_dir, "customer_part", scratch=scratch), scratch.path("adj"))
    layout = W.lay_out(lists, scratch=scratch, biased=True).persist()
    state = W.walk_start(layout, WALKS, SEED)
    walks = scratch.cut(W.as_walks(W.walk_step(state, layout, 1, 2.0, 0.5, SEED), layout, 2), "walks")
    layout.release()
    return as_text(walks)


@query
def random_walk(spark, sf_dir):
    """O-34"""
    return as_text(_walks(spark, sf_dir, "customer_part"))


@query
def random_walk_pq(spark, sf_dir):
    """O-34 with a return and in-out bias."""
    return as_text(_walks(spark, sf_dir, "customer_part", 0.25, 4.0))


@query
def random_walk_long(spark, sf_dir):
    """O-34 at the default length, through the stretches."""
    return as_text(_walks(spark, sf_dir, "customer_part", steps=LONG_STEPS, walks=1))


@query
def random_walk_pq_long(spark, sf_dir):
    """O-34 at the default length with a return and in-out bias."""
    return as_text(_walks(spark, sf_dir, "customer_part", 0.25, 4.0, LONG_STEPS, 1))


@query
def random_walk_alias(spark, sf_dir):
    """O-34 at the default length, drawn by alias tables."""
    return as_text(_walks(spark, sf_dir, "customer_part", steps=LONG_STEPS, walks=1, method="alias"))


@query
def random_walk_alias_tri(spark, sf_dir):
    """O-34 on a graph with triangles, drawn by alias tables and rejection, through the stretches."""
    return as_text(_walks(spark, sf_dir, "tripartite", 0.25, 0.5, 20, 1, method="alias"))


@query
def random_walk_tri(spark, sf_dir):
    """O-34 on a graph with triangles."""
    return as_text(_walks(spark, sf_dir, "tripartite", 2.0, 0.5))


@query
def random_walk_hubs(spark, sf_dir):
    """O-34 on a graph with hubs, which are spread over copies, in several stretches."""
    scratch = Scratch(spark)
    adj = _adj(spark, sf_dir, "supplier_part", scratch=scratch)
    walks = W.random_walk(adj, STEPS, WALKS, 4.0, 1.0, SEED, checkpoint_every=3,
                          scratch=scratch, walks_per_task=200)
    return as_text(walks)


@query
def random_walk_directed(spark, sf_dir):
    """O-34 along the direction of edges; suppliers have no way out, so walks end there."""
    scratch = Scratch(spark)
    graph = G.indexed(spark, sf_dir, "tripartite", scratch)
    adj = graph.adjacency(DEGREE, directed=True)
    return as_text(W.random_walk(adj, STEPS, WALKS, 1.0, 1.0, SEED, directed=True,
                                 checkpoint_every=2, scratch=scratch))


@query
def multi_walk(spark, sf_dir):
    """O-32: walk sets from customers and from parts, as one."""
    scratch = Scratch(spark)
    graph = G.indexed(spark, sf_dir, "customer_part", scratch)
    lists = hold_lists(graph.adjacency(DEGREE), scratch.path("adj"))
    # Laid out once, with copies for the walks of both sets.
    hubs = scratch.cut(W.find_hubs(lists.table, 3), "hubs")
    layout = W.lay_out(lists, hubs, scratch=scratch).persist()
    sets = [W.random_walk(layout, 2, 3, seed=SEED, starts=graph.node2id.where(F.col("node").startswith(t)),
                          scratch=scratch) for t in ("c", "p")]
    layout.release()
    return as_text(W.multi_walk(sets))


@query
def feature_walk(spark, sf_dir):
    """O-35"""
    walks = W.feature_walk(_walks(spark, sf_dir, "user_key", 0.5, 2.0))
    return walks.select("walk_no", "start", X.joined(F.col("feats"), " ").alias("feats_text"))


@query
def hop_tag(spark, sf_dir):
    """O-27"""
    scratch = Scratch(spark)
    lists = hold_lists(_adj(spark, sf_dir, "tripartite", scratch=scratch), scratch.path("adj"))
    return W.hop_tag(W.random_walk(lists, STEPS, WALKS, seed=SEED, scratch=scratch), lists)


# Names and text.

def _named_walks(spark, sf_dir, graph="customer_part"):
    scratch = Scratch(spark)
    g = G.indexed(spark, sf_dir, graph, scratch)
    walks = W.random_walk(g.adjacency(DEGREE), STEPS, WALKS, seed=SEED, scratch=scratch)
    return g, N.walks_named(walks, g.node2id)


@query
def walks_named(spark, sf_dir):
    """O-17"""
    _, named = _named_walks(spark, sf_dir)
    return named.select("walk_no", "node", "start", X.joined(F.col("path"), " ").alias("path_text"))


@query
def walks_with_feat(spark, sf_dir):
    """O-18"""
    g, named = _named_walks(spark, sf_dir)
    rows = N.walks_with_feat(named, P.node2feat(g.padded))
    return rows.select("walk_no", "node", "start", "feat",
                       X.joined(F.col("feats"), " ").alias("feats_text"))


@query
def walk_text(spark, sf_dir):
    """O-12, O-13, O-43"""
    return Wr.walk_lines(_named_walks(spark, sf_dir)[1])


@query
def feat_walk_text(spark, sf_dir):
    """O-44"""
    return Wr.feat_walk_lines(_named_walks(spark, sf_dir)[1])


@query
def feat_walk2_text(spark, sf_dir):
    """O-45"""
    g, named = _named_walks(spark, sf_dir)
    return Wr.feat_walk2_lines(N.walks_with_feat(named, P.node2feat(g.padded)))


@query
def node2id_text(spark, sf_dir):
    """O-41: the index written as text and read back."""
    scratch = Scratch(spark)
    ids = G.indexed(spark, sf_dir, "supplier_part", scratch).node2id
    return R.read_node2id(spark, scratch.text(Wr.node2id_lines(ids)), "text")


# Vectors.

TRAIN = Params(seed=SEED)


def sound(vector: Column) -> Column:
    """Whether a vector is finite and not all zero."""
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return finite & F.exists(vector, lambda x: x != 0)


@query
def id_corpus(spark, sf_dir):
    """O-36"""
    corpus = E.id_corpus(_walks(spark, sf_dir, "customer_part"))
    return corpus.select(F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"))


@query
def feat_corpus(spark, sf_dir):
    """O-37"""
    corpus = E.feat_corpus(_walks(spark, sf_dir, "user_key", 0.5, 2.0))
    return corpus.select(X.joined(F.col("tokens"), " ").alias("tokens_text"))


@query
def embed_vocab(spark, sf_dir):
    """O-38, O-39: every feature met gets a vector of the given size."""
    corpus = E.feat_corpus(_walks(spark, sf_dir, "customer_part"))
    rows = E.vectors(E.fit_vectors(corpus, TRAIN))
    return rows.select("word", F.size("vector").alias("dim"), sound(F.col("vector")).alias("sound"))


@query
def node_vectors(spark, sf_dir):
    """O-20, O-47: a vector for every vertex, beside its name and id."""
    scratch = Scratch(spark)
    g = G.indexed(spark, sf_dir, "user_key", scratch)
    walks = W.random_walk(g.adjacency(DEGREE), STEPS, WALKS, seed=SEED, scratch=scratch)
    rows = N.node_vectors(E.vectors(E.fit_vectors(E.id_corpus(walks), TRAIN)), g.node2id)
    return rows.select("node", "id", F.size("vector").alias("dim"), sound(F.col("vector")).alias("sound"))


@query
def feat_vectors(spark, sf_dir):
    """O-21, O-48: the vector of its feature for every vertex whose feature was met."""
    scratch = Scratch(spark)
    g = G.indexed(spark, sf_dir, "user_key", scratch)
    walks = W.random_walk(g.adjacency(DEGREE), STEPS, WALKS, seed=SEED, scratch=scratch)
    model = E.fit_vectors(E.feat_corpus(walks), TRAIN)
    rows = N.feat_vectors(E.vectors(model), P.node2feat(g.padded, "both"))
    return rows.select("node", "feat", F.size("vector").alias("dim"), sound(F.col("vector")).alias("sound"))


@query
def model_reload(spark, sf_dir):
    """O-07, O-46: the vocabulary of a model saved and loaded again."""
    scratch = Scratch(spark)
    corpus = E.feat_corpus(_walks(spark, sf_dir, "user_key"))
    path = scratch.path("model")
    Wr.save_model(E.fit_vectors(corpus, TRAIN), path)
    rows = E.vectors(R.load_model(path))
    return rows.select("word", F.size("vector").alias("dim"), sound(F.col("vector")).alias("sound"))


# Whole runs, from text files to text files.

def _run_inputs(spark, sf_dir, scratch):
    """Edge and feature files of the customer-part graph, and the settings of a run on them."""
    graph = G.customer_part(spark, sf_dir)
    two = lambda df, *cols: df.select(F.concat_ws(" ", *cols).alias("value"))
    return Params(
        input=scratch.text(two(graph.edges, "src", "dst"), "edges"),
        feat_path1=scratch.text(two(graph.feat1, "node", "feat"), "feat1"),
        feat_path2=scratch.text(two(graph.feat2, "node", "feat"), "feat2"),
        output=scratch.path("out"), feat_walk_path=scratch.path("feats"),
        walk_length=STEPS, num_walks=WALKS, degree=DEGREE, seed=SEED)


@query
def run_padding(spark, sf_dir):
    """O-49"""
    scratch = Scratch(spark)
    params = _run_inputs(spark, sf_dir, scratch)
    C.padding(spark, params)
    return spark.read.text(params.output + ".padd")


@query
def run_random_walk(spark, sf_dir):
    """O-50 on the output of O-49, at the default length: the three walk files as written."""
    scratch = Scratch(spark)
    params = _run_inputs(spark, sf_dir, scratch).but(walk_length=LONG_STEPS)
    C.padding(spark, params)
    C.random_walks(spark, params.but(input=params.output + ".padd"))
    return _walk_files(spark, params)


@query
def run_one_write(spark, sf_dir):
    """O-43 to O-45 by O-50 in one pass over the walks; the same lines as three sinks apart."""
    scratch = Scratch(spark)
    params = _run_inputs(spark, sf_dir, scratch).but(sinks_path=scratch.path("sinks"))
    C.padding(spark, params)
    C.random_walks(spark, params.but(input=params.output + ".padd"))
    return spark.read.schema("value string, sink string").option("basePath", params.sinks_path).text(params.sinks_path)


@query
def run_from_starts(spark, sf_dir):
    """O-50 from the vertices of the first type only, at the default length, with the index as text."""
    scratch = Scratch(spark)
    graph = G.customer_part(spark, sf_dir)
    starts = scratch.text(graph.feat1.select(F.col("node").alias("value")), "starts")
    params = _run_inputs(spark, sf_dir, scratch).but(walk_length=LONG_STEPS, num_walks=1, starts_path=starts, index_format="text")
    C.padding(spark, params)
    C.random_walks(spark, params.but(input=params.output + ".padd"))
    return _walk_files(spark, params)


def _walk_files(spark, params):
    ids, feats, feats2 = (spark.read.text(path).select(F.lit(sink).alias("sink"), "value") for sink, path in (
        ("ids", params.output), ("feats", params.feat_walk_path), ("feats2", params.feat_walk_path + "2")))
    return ids.unionByName(feats).unionByName(feats2)


@query
def run_embedding(spark, sf_dir):
    """O-51 on written feature walks: vertices and features that got a vector."""
    scratch = Scratch(spark)
    params = _run_inputs(spark, sf_dir, scratch)
    C.padding(spark, params)
    C.random_walks(spark, params.but(input=params.output + ".padd"))
    C.embedding(spark, params.but(input=params.feat_walk_path, output=scratch.path("vectors"),
                                  node_path=params.feat_walk_path + ".node2feat"))
    return _vector_keys(spark, scratch.root)


@query
def run_full(spark, sf_dir):
    """O-52: ids of all vertices that got a vector, from padded edges in one go."""
    scratch = Scratch(spark)
    params = _run_inputs(spark, sf_dir, scratch)
    C.padding(spark, params)
    out = scratch.path("all")
    C.full(spark, params.but(input=params.output + ".padd", output=out))
    lines = spark.read.text(out + ".emb")
    return lines.select(F.split_part("value", F.lit("\t"), F.lit(1)).alias("node"), *_numbers(2))


@query
def run_full_features(spark, sf_dir):
    """O-52 with vectors of features: each source vertex with its feature's vector."""
    scratch = Scratch(spark)
    params = _run_inputs(spark, sf_dir, scratch)
    C.padding(spark, params)
    C.full(spark, params.but(input=params.output + ".padd", output=scratch.path("vectors"), vectors="features"))
    return _vector_keys(spark, scratch.root)


@query
def run_half_indexed(spark, sf_dir):
    """O-42 as the walk command writes it."""
    scratch = Scratch(spark)
    params = _run_inputs(spark, sf_dir, scratch)
    C.padding(spark, params)
    C.random_walks(spark, params.but(input=params.output + ".padd", walk_length=0, num_walks=1, half_indexed=True))
    return spark.read.text(params.feat_walk_path + ".j2")


@query
def run_indexed(spark, sf_dir):
    """O-08, O-50 on edges by id, with an index that names the even ids only; other vertices go by their id."""
    scratch = Scratch(spark)
    graph = G.indexed(spark, sf_dir, "customer_part", scratch, weighted=False)
    end = lambda v, f: F.concat_ws(SEPARATOR, F.col(v).cast("string"), f)
    lines = graph.edges.select(F.concat_ws(" ", end("src_id", "src_feat"), end("dst_id", "dst_feat")).alias("value"))
    names = scratch.path("names")
    Wr.write_node2id(graph.node2id.where("id % 2 = 0"), names)
    params = _run_inputs(spark, sf_dir, scratch).but(input=scratch.text(lines, "indexed"), indexed=True, node_path=names)
    C.random_walks(spark, params)
    return _walk_files(spark, params)


@query
def walks_from_lists(spark, sf_dir):
    """O-25, O-34 on neighbour lists saved as a bucketed table and opened again."""
    scratch = Scratch(spark)
    path = scratch.path("lists")
    save_lists(_adj(spark, sf_dir, "customer_part", scratch=scratch), path)
    return as_text(W.random_walk(open_lists(spark, path), STEPS, WALKS, seed=SEED, scratch=scratch))


def _numbers(part: int) -> list[Column]:
    vector = F.split(F.split_part("value", F.lit("\t"), F.lit(part)), ",").cast("array<float>")
    return [F.size(vector).alias("dim"), sound(vector).alias("sound")]


def _vector_keys(spark, root):
    lines = spark.read.text(root + "/*-vectors.emb")
    return lines.select(F.split_part("value", F.lit("\t"), F.lit(1)).alias("node"),
                        F.split_part("value", F.lit("\t"), F.lit(2)).alias("feat"),
                        *_numbers(3))
