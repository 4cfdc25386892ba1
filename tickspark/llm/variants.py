"""Spelling variants by walking a trie that is a table: states joined with edges, level by level.

Every word is put into two tries, as it is and reversed. Nodes are prefixes (by hash) at which words
part or end; an edge (node, label, child) is the stretch of letters to the next such prefix, so
unary paths are one edge whatever their length. A state is (word, what is left of it, node, edits).
States without an edit are the word's own path. Where they leave it, by a letter replaced with one
that sorts later or by a letter left out, they turn into one-edit states, which must follow the
edges letter by letter; one that uses up its word at a node where a word ends has found a neighbour.
Letters put in are letters left out of the neighbour, so both members of each pair get the link.

Edits lie in the later half of the word in one of its two tries, so states begin deep in the trie,
where few words share a node. The last letter of a stretch of equal ones stands for the stretch,
hence an edit always happens at a node of the table, never inside an edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import cut

#: Letters A-Z, a-z and the Latin-1 block from À to ÿ; a run is a longest stretch of them.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST = 7
LEAST_SEEN = 2
#: A word is a variant of a near word that is seen so many times as often.
RATIO = 10


def runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, run): the letter runs of at least ``shortest`` code points, A-Z lower-cased. Null and
    empty texts have none."""
    found = F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("_r")).select("doc_id", F.translate("_r", UPPER, LOWER).alias("run"))


def misspelt(runs: DataFrame, every: int = 31) -> Column:
    """``run`` with one letter left out where ``every`` divides the crc32 of ``<doc_id>:<run>``
    (a null id is written as nothing)."""
    h = F.crc32(F.concat(F.coalesce(runs.doc_id.cast("string"), F.lit("")), F.lit(":"), runs.run))
    at = (h % F.length(runs.run)).cast("int")
    short = F.concat(F.substring(runs.run, F.lit(1), at), F.substring(runs.run, at + 2, F.length(runs.run)))
    return F.when(h % every == 0, short).otherwise(runs.run)


def word_counts(words: DataFrame, shortest: int = SHORTEST, least: int = LEAST_SEEN) -> DataFrame:
    """(word, n) of the column ``word``: those long and frequent enough. Counts combine map-side."""
    return (words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least))


def _trie(words: DataFrame, shortest: int) -> DataFrame:
    """(word, n, side, s, path): each word forwards (side 0) and reversed (1) as ``s``, with the
    (depth, node) of the nodes on its path, from half the shortest length on."""
    top = shortest // 2
    sides = words.select("wid", F.posexplode(F.array("word", F.reverse("word"))).alias("side", "s"))
    steps = sides.select("wid", "side", F.explode(F.transform(
        F.sequence(F.lit(top), F.length("s")),
        lambda d: F.struct(d.alias("depth"), F.xxhash64(F.col("side"), F.substring(F.col("s"), F.lit(1), d)).alias("node"),
                           F.ascii(F.substring(F.col("s"), d + 1, F.lit(1))).alias("letter")))).alias("x")).select("wid", "side", "x.*")
    # words part where letters differ; letter 0 is a word's end
    parting = (steps.where(F.col("depth") > top).groupBy("node").agg(F.min("letter").alias("_a"), F.max("letter").alias("_b"))
               .where("_a = 0 or _a <> _b").select("node"))
    kept = steps.select("wid", "side", "depth", "node")
    paths = (kept.where(F.col("depth") > top).join(parting, "node", "left_semi").select(kept.columns)
             .unionByName(kept.where(F.col("depth") == top))
             .groupBy("wid", "side").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("path")))
    return (paths.join(words, "wid")
            .select("word", "n", "side", F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")).alias("s"), "path"))


def _rest(s, depth) -> Column:
    return F.substring(s, depth + 1, F.length(s))


def neighbours(words: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words one edit apart, once. ``words`` has
    distinct words of at least ``shortest`` code points and their counts n."""
    numbered = cut(words.select("word", "n").withColumn("wid", F.monotonically_increasing_id()))
    trie = cut(_trie(numbered, shortest))
    pair = F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path")).alias("b")))
    edges = cut(trie.where(F.size("path") > 1).select("s", pair.alias("e"))
                .select(F.col("e.a.node").alias("node"), F.col("e.b.node").alias("child"),
                        F.expr("substring(s, e.a.depth + 1, e.b.depth - e.a.depth)").alias("label")).distinct())
    ends = trie.select(F.element_at("path", -1)["node"].alias("node"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    half = F.when(F.col("side") == 0, F.floor(F.length("s") / 2)).otherwise(F.length("s") - F.floor(F.length("s") / 2))
    own = (trie.select("word", "n", "s", half.alias("_half"), F.explode("path").alias("p"))
           .where("p.depth >= _half and p.depth < length(s)")
           .select("word", "n", F.col("p.node").alias("node"), _rest(F.col("s"), F.col("p.depth")).alias("rest")))
    rest, label = F.col("rest"), F.col("label")
    first, second = F.substring(rest, 1, 1), F.substring(rest, 2, 1)
    out = F.expr("substring(rest, 2)")
    tail = F.expr("substring(label, 2)")
    replaced = (F.substring(label, 1, 1) > first) & out.startswith(tail)
    dropped = (first != second) & out.startswith(label)
    branch = own.join(edges, "node").where(replaced | dropped)
    # an edge can take a state both ways: its first letter replaced, or the letter before it left out
    went = branch.select("word", "n", F.col("child").alias("node"), F.explode(F.array(
        F.when(replaced, F.expr("substring(rest, length(label) + 1)")),
        F.when(dropped, F.expr("substring(rest, length(label) + 2)")))).alias("rest")).where("rest is not null")
    states = cut(went.unionByName(own.where(F.length("rest") == 1).withColumn("rest", F.lit(""))))
    done = [states.where("rest = ''")]
    states = states.where("rest <> ''")
    while not states.isEmpty():
        states = cut(states.join(edges, "node").where(rest.startswith(label))
                     .select("word", "n", F.col("child").alias("node"), F.expr("substring(rest, length(label) + 1)").alias("rest")))
        done.append(states.where("rest = ''"))
        states = states.where("rest <> ''")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    # nodes are hashes: the words themselves decide
    links = (found.join(ends, "node").where(F.levenshtein("word", "near", 1) == 1)
             .select("word", "n", "near", "near_n"))
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"),
                             F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"),
                                      F.col("n").alias("near_n")))).alias("l")
    return links.select(both).select("l.*").distinct()


def variants(words: DataFrame, shortest: int = SHORTEST, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of ``words`` (word, n: distinct words).

    form is the near word seen most (ties: smallest in code-point order) if it is seen at least
    ``ratio`` times as often, else null; root is where following forms ends (the word itself without
    one). Counts rise tenfold along forms, so chains are short and never circle. An empty table
    gives no rows; shorter words must not be passed (``word_counts`` leaves them out).
    """
    words = cut(words.select("word", "n"))
    near = cut(neighbours(words, shortest).groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("_best"))
        .select("word", "n", "n_near", F.col("_best.near").alias("form"), (-F.col("_best.m")).alias("form_n")))
    forms = near.where(F.col("form_n") >= F.col("n") * ratio).select("word", "form", "form_n")
    roots = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("_to"))
        if roots.join(step, "root", "left_semi").isEmpty():
            break
        roots = cut(roots.join(step, "root", "left").select("word", F.coalesce("_to", "root").alias("root")))
    return (words.join(near.select("word", "n_near"), "word", "left").join(forms, "word", "left").join(roots, "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n",
                    F.coalesce("root", "word").alias("root")))
