"""Chat formatting with prefix trees: shared turns once, positions and attention intervals attached."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from colsieve.llm.shared import table, written

#: A tree of more characters than this is dealt out over several packs, subtree by subtree.
PACK_CHARS = 1_000_000
#: The control strings of the template, and the letter that stands for each behind a backslash in escaped texts.
CONTROL = {"<s>": "b", "</s>": "e", "[INST]": "i", "[/INST]": "o"}
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_BACK = {letter: control for control, letter in CONTROL.items()} | {"\\": "\\"}
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\] (.*?)</s>", re.DOTALL)
LEARNED = "assistant"

SEGMENT = "struct<parent:int,first:int,length:int,position:int,loss_first:int,loss_end:int,attends:array<struct<first:int,end:int>>>"
PACK = f"pack string, stream string, segments array<{SEGMENT}>, paths array<struct<path:string,segment:int>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + CONTROL.get(m.group(), "\\"), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m.group(1)], text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends."""
    head, body = f"<s>[INST] {escape(role)} [/INST] ", escape(text)
    return f"{head}{body}</s>", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, path, nodes, roles, texts): every conversation's turns in order, and a key for each of its beginnings.

    Turns are ordered by number, ties by role and text; null numbers come first, null roles and texts are empty.
    Rows without conv_id are one conversation. ``path`` is the key of the whole.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t")).select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))

    @F.pandas_udf("array<string>")
    def keys(roles: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for rs, ts in zip(roles, texts):
            chain, key = [], b""
            for r, t in zip(rs, ts):
                r, t = r.encode(), t.encode()
                key = hashlib.blake2b(key + len(r).to_bytes(8, "big") + r + t, digest_size=16).digest()
                chain.append(key.hex())
            out.append(chain)
        return pd.Series(out, dtype=object)

    return ordered.withColumn("nodes", keys("roles", "texts")).select("conv_id", F.element_at("nodes", -1).alias("path"), "nodes", "roles", "texts")


def tree(paths: list[tuple[str, list[str], list[str], list[str]]]) -> tuple[str, list[tuple], list[tuple[str, int]]]:
    """(stream, segments, paths) of one pack: the turns of (path, nodes, roles, texts) rows, each shared turn once, depth first."""
    paths = sorted(paths, key=lambda p: list(zip(p[2], p[3])))  # neighbours share beginnings: this is depth first
    pieces, segments, ends, at, trail = [], [], [], 0, []
    for path, nodes, roles, texts in paths:
        same = 0
        while same < min(len(trail), len(nodes)) and trail[same][0] == nodes[same]:
            same += 1
        del trail[same:]
        for node, role, text in zip(nodes[same:], roles[same:], texts[same:]):
            piece, first, end = render(role, text)
            parent = trail[-1][1] if trail else -1
            position, attends = 0, []
            if trail:
                up = segments[parent]
                position = up[3] + up[2]
                attends = [*up[6]]
                if attends and attends[-1][1] == up[1]:
                    attends[-1] = (attends[-1][0], up[1] + up[2])
                else:
                    attends.append((up[1], up[1] + up[2]))
            loss = (at + first, at + end) if role == LEARNED else (at, at)
            segments.append((parent, at, len(piece), position, *loss, attends))
            trail.append((node, len(segments) - 1))
            pieces.append(piece)
            at += len(piece)
        ends.append((path, trail[-1][1]))
    return "".join(pieces), segments, ends


def packs(distinct: DataFrame, most: int = PACK_CHARS) -> DataFrame:
    """Prefix trees of different conversations (path, nodes, roles, texts), one row for each pack.

    ``stream`` holds every turn of the pack once, depth first. Each segment (a turn) has its first character and length
    in the stream, the position id of its first character (they count on from its ancestors'), the interval under the
    loss mask and the intervals that it attends to: its ancestors', neighbours joined, besides its own characters
    so far. ``paths`` names each conversation's last segment.
    A tree is one pack. Where more than ``most`` characters stand below a turn, the subtrees below it are dealt out by
    hash over as many packs as needed, which repeat the turns above; the last such turn of a path decides.
    """
    size = F.aggregate("texts", F.lit(0).cast("long"), lambda s, t: s + F.char_length(t) + 32)
    below = distinct.select("path", size.alias("size"), F.posexplode("nodes").alias("depth", "node"))
    heavy = below.groupBy("node").agg(F.sum("size").alias("weight")).where(F.col("weight") > most)
    last = below.join(heavy, "node").groupBy("path").agg(F.max(F.struct("depth", "node", "weight")).alias("h"))
    child = F.coalesce(F.get("nodes", F.col("h.depth") + 1), F.lit(""))
    bins = F.ceil(F.col("h.weight") / most)
    pack = F.when(F.col("h").isNull(), F.col("nodes")[0]).otherwise(F.concat_ws("-", "h.node", F.pmod(F.xxhash64(child), bins)))
    dealt = distinct.join(last, "path", "left").select(pack.alias("pack"), F.struct("path", "nodes", "roles", "texts").alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, *columns in zip(*(batch[c] for c in ("pack", "path", "nodes", "roles", "texts"))):
                stream, segments, ends = tree([(p, *map(list, rest)) for p, *rest in zip(*columns)])
                names = ("parent", "first", "length", "position", "loss_first", "loss_end", "attends")
                as_rows = [dict(zip(names, (*rest, [{"first": f, "end": e} for f, e in attends]))) for *rest, attends in segments]
                rows.append((name, stream, as_rows, [{"path": p, "segment": s} for p, s in ends]))
            yield pd.DataFrame(rows, columns=["pack", "stream", "segments", "paths"])

    gathered = dealt.groupBy("pack").agg(F.collect_list("p").alias("p")).select("pack", *[F.col(f"p.{c}").alias(c) for c in ("path", "nodes", "roles", "texts")])
    return gathered.mapInPandas(run, PACK)


READ = "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(packed: DataFrame) -> DataFrame:
    """What each path of the packs says, from its attention intervals, positions and loss mask alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for stream, segments, paths in zip(batch["stream"], batch["segments"], batch["paths"]):
                for end in paths:
                    own = segments[end["segment"]]
                    text = "".join(stream[a["first"] : a["end"]] for a in own["attends"]) + stream[own["first"] : own["first"] + own["length"]]
                    assert len(text) == own["position"] + own["length"]
                    loss, k = [], end["segment"]
                    while k >= 0:
                        loss.append(unescape(stream[segments[k]["loss_first"] : segments[k]["loss_end"]]))
                        k = segments[k]["parent"]
                    learned, turns = "".join(reversed(loss)), parse(text)
                    said = "".join(f"{role}\n{words}\n" for role, words in turns)
                    rows.append((end["path"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])

    return packed.mapInPandas(run, READ)


def format_conversations(turns: DataFrame, most: int = PACK_CHARS) -> tuple[DataFrame, DataFrame]:
    """(packs, conv_id and path of every conversation). Equal conversations are one path."""
    known = written(conversations(turns), "conversations")
    distinct = known.groupBy("path").agg(*[F.first(c).alias(c) for c in ("nodes", "roles", "texts")])
    return packs(distinct, most), known.select("conv_id", "path")


def op2_chat(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    packed, known = format_conversations(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").union(more))
    return known.join(read_back(packed), "path").drop("path")


QUERIES = {"op2_chat": op2_chat}
SQL: dict[str, str] = {}
