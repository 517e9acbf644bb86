"""The groups of a main tier: nested <...> with the marks behind them, as a tree from one pass over the tier's tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"<|>|\[[^\[\]]*\]|&\*[A-Za-z0-9]+:[^\s<>\[\]]+|[^\s<>\[\]]+"
#: Marks by which what stands before them is said again; words that stand for speech that was not understood.
RETRACES = ("[/]", "[//]", "[///]", "[/-]", "[/?]")
UNTRANSCRIBED = ("xxx", "yyy", "www")
_TOKENS = pa.struct([("at", pa.int32()), ("text", pa.string()), ("kind", pa.string()), ("group", pa.int32())])
_GROUPS = pa.struct([("group", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("marks", pa.list_(pa.string())), ("retraced", pa.bool_())])
_PARSED = "struct<tokens:array<struct<at:int,text:string,kind:string,group:int>>,groups:array<struct<group:int,parent:int,depth:int,first:int,last:int,marks:array<string>,retraced:boolean>>>"


def _kind(x: str) -> str:
    return {"<": "open", ">": "close"}.get(x) or ("mark" if x.startswith("[") else "event" if x.startswith("&*") else "word")


def _tree(tokens: list[str]) -> tuple[list[int], list[tuple]]:
    """The group of each token, and the groups, from one pass with a stack."""
    own, stack, found = [], [0], []
    for at, x in enumerate(tokens):
        if x == "<":
            found.append([len(found) + 1, stack[-1], len(stack), at, len(tokens)])
            stack.append(len(found))
        own.append(stack[-1])
        if x == ">" and stack[-1]:
            found[stack.pop() - 1][4] = at
    out: list[tuple] = []
    for g in found:
        end = g[4] + 1
        while end < len(tokens) and tokens[end].startswith("["):
            end += 1
        marks = tokens[g[4] + 1 : end]
        # a group's parent has the smaller number, so what holds of the parent is known by then
        out.append((*g, marks, any(m in RETRACES for m in marks) or bool(g[1] and out[g[1] - 1][6])))
    return own, out


def parsed(text: Column) -> Column:
    """struct<tokens array<struct<at, text, kind, group>>, groups array<struct<group, parent, depth, first, last, marks, retraced>>>.

    Tokens are numbered from 0; kind is open, close, mark, event or word. Group 0 is the tier itself; groups are numbered as they
    open, and first and last are the places of their brackets. A bracket > that closes nothing belongs to no group; a group
    that isn't closed ends with the tier. marks: the annotations right behind a group. retraced: said again, or inside a group that is.
    """

    @F.arrow_udf(_PARSED)
    def run(tokens: pa.Array) -> pa.Array:
        texts, at, own, found, ends = tokens.flatten(), [], [], [], [0]
        for t in tokens.to_pylist():
            o, g = _tree(t or [])
            at += range(len(o))
            own += o
            found += g
            ends.append(len(found))
        size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        kinds = pa.array([_kind(x) for x in texts.to_pylist()], pa.string())
        one = pa.StructArray.from_arrays([pa.array(at, pa.int32()), texts.cast(pa.string()), kinds, pa.array(own, pa.int32())], fields=list(_TOKENS))
        columns = list(zip(*found, strict=True)) or [()] * len(_GROUPS)
        all_ = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _GROUPS, strict=True)], fields=list(_GROUPS))
        starts = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        listed = pa.ListArray.from_arrays(starts, one, mask=pa.array(tokens.is_null().to_numpy(zero_copy_only=False)))
        return pa.StructArray.from_arrays([listed, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), all_)], ["tokens", "groups"])

    # what is read off the tree must not have it built once more below itself
    return run.asNondeterministic()(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def groups(rows: DataFrame, *keep: str) -> DataFrame:
    """SRC-26: the groups of main tiers (text), one row each: group, parent, depth, first, last, marks, retraced."""
    return rows.select(*keep, parsed(F.col("text")).alias("_p")).select(*keep, F.inline("_p.groups"))


def words(rows: DataFrame, *keep: str) -> DataFrame:
    """FLT-14, FLT-16: the words of main tiers (text): at, word, group, category and retraced (said again later).

    category: word, untranscribed, filler (&-), fragment (&+ and &~), omission (0...), mark (+..., punctuation).
    """
    p = rows.select(*keep, parsed(F.col("text")).alias("_p")).select(*keep, "_p.*")
    inside = lambda x: F.coalesce(F.get(F.col("groups"), x["group"] - 1).retraced, F.lit(False))
    after = lambda x: F.coalesce(F.get("tokens", x["at"] + 1).text, F.lit(""))
    again = lambda x: inside(x) | after(x).isin(*RETRACES)
    text = lambda x: x["text"]
    category = lambda x: (
        F.when(text(x).isin(*UNTRANSCRIBED), "untranscribed").when(text(x).startswith("&-"), "filler").when(text(x).rlike(r"^&[+~]"), "fragment")
        .when(text(x).rlike(r"^0\p{L}"), "omission").when(~text(x).rlike(r"[\p{L}\p{N}]") | text(x).startswith("+"), "mark").otherwise("word")
    )
    found = F.transform(F.filter("tokens", lambda x: x.kind == "word"), lambda x: F.struct(x["at"].alias("at"), x["text"].alias("word"), x["group"].alias("group"), category(x).alias("category"), again(x).alias("retraced")))
    return p.select(*keep, F.inline(found))


def countable(words_: DataFrame, retracings: bool = False, omissions: bool = False) -> DataFrame:
    """FLT-14, FLT-16: words that count; those said again only with ``retracings``, left out ones only with ``omissions``."""
    kinds = ["word", *(["omission"] if omissions else [])]
    return words_.where(F.col("category").isin(*kinds) & (F.lit(retracings) | ~F.col("retraced")))


def events(rows: DataFrame, linker: bool = False) -> DataFrame:
    """EXP-01: (file, idx, nth, speaker, text): each utterance (file, idx, speaker, text) without its inline events of other
    speakers (&*WHO:some_words), as nth 0, and those events after it as utterances of their own: words split at _, a period at
    the end, with +< before it if ``linker``. Events inside a group come before those of the group around it: groups go in the order in which
    they close, the tier itself last; those of one group by place."""
    p = rows.select("file", "idx", "speaker", "text", parsed(F.col("text")).alias("p"))
    end = lambda x: F.coalesce(F.get(F.col("p.groups"), x["group"] - 1).last, F.lit(2_000_000_000))
    found = F.sort_array(F.transform(F.filter("p.tokens", lambda x: x.kind == "event"), lambda x: F.struct(end(x).alias("end"), x["at"].alias("at"), x["text"].alias("text"))))
    said = lambda e: F.concat(F.lit("+< " if linker else ""), F.replace(F.regexp_extract(e, r":(.*)$", 1), F.lit("_"), F.lit(" ")), F.lit(" ."))
    new = F.transform(found, lambda e, i: F.struct((i + 1).alias("nth"), F.regexp_extract(e["text"], r"&\*([A-Za-z0-9]+)", 1).alias("speaker"), said(e["text"]).alias("text")))
    host = F.trim(F.regexp_replace(F.regexp_replace("text", r"&\*[A-Za-z0-9]+:[^\s<>\[\]]+", ""), r"\s+", " "))
    return p.select("file", "idx", F.inline(F.concat(F.array(F.struct(F.lit(0).alias("nth"), F.col("speaker"), host.alias("text"))), new)))
