r"""Chat formatting: records of several layouts become canonical turns, then one text with a loss mask.

A record is a JSON object. Its schema fingerprint is the hash of its sorted nested field paths (an array adds "[]"), of those that some mapping names:
ids, scores and the like do not change it. The fingerprint selects a declarative mapping, which names where the turns' roles and texts are,
with and without its optional fields (a system text, a history, calls of tools). A record that has fields of several layouts goes to the first of which it has all the required ones, if that loses no text: a
record with a text that its mapping doesn't name, and whose field is no METADATA, is of an unknown layout. New
layouts are new entries of LAYOUTS, no new code. Role names are made canonical in the layouts of other makers; the layout "turns" is this library's own, and its roles stay.

Template: a turn is `<s>[role]text</s>`. Inside roles and texts, each of `\`, `<`, `[` and `]` is written after a `\`, so
that no control string can come from a text, and removing those backslashes gives the text back. The loss mask is a
list of code-point spans of the formatted text: the assistants' texts.

Nulls: a null text or role is empty, a null turn number comes first, and a row of a null conv_id is a conversation of its own, as nothing bounds how many there are. Equal turn numbers are ordered by role, then text;
repeated rows are turns of their own. A record of an unknown layout has `layout` null and is one turn of the role "record", so that no text is lost; a null record has
no turns. A missing or empty optional field (system, input) gives no turn. A text or role that is no string is written as JSON. Empty tables give no rows. Further columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices

ESCAPED = re.compile(r"[\\<\[\]]")
BACK = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"<s>\[((?:[^\\\]]|\\.)*)\]((?:[^\\<]|\\.)*)</s>", re.S)
LEARNED = "assistant"
#: Names of roles in public datasets, and the canonical ones.
ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
#: Names of fields whose texts are no part of a conversation, at any depth.
METADATA = ("category", "created", "dataset", "id", "lang", "language", "license", "metadata", "model", "name", "source", "tags", "timestamp", "type", "url", "uuid")


@dataclass(frozen=True)
class Layout:
    """paths: the nested field paths that a record must have; optional: others that it may have. items: the field of a list of turns, with the
    fields of role and text in each, and calls: a field of an item that is added to its text as JSON; or fields: pairs of role and top-level field, and joined: fields added to a turn's text after a blank line.
    A top-level `system` is the first turn; a `history` beside fields, of pairs of a user's and an assistant's text or of objects with role and content, comes before them. roles: canonical names of roles."""

    name: str
    paths: tuple[str, ...]
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    joined: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    calls: str | None = None

    @property
    def fingerprints(self) -> list[str]:
        return [path_hash((*self.paths, *some)) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)]

    def names(self, path: str) -> bool:
        """Whether the mapping uses what stands at the path, or within what does."""
        used = (*self.paths, *self.optional)
        return any(path == p or path.startswith((f"{p}.", f"{p}[")) for p in used)

    def turns(self, record: dict) -> list[tuple[str, str]]:
        if self.items:
            where, role, text = self.items
            names = dict(self.roles)
            out = [("system", _text(record["system"]))] if "system" in self.optional and _text(record.get("system")) else []
            for x in record.get(where) or []:
                if isinstance(x, dict):
                    body, called = _text(x.get(text)), _text(x.get(self.calls) or None) if self.calls else ""
                    out.append((names.get(r := _text(x.get(role)), r), "\n\n".join(filter(None, (body, called)))))
            return out
        more = dict(self.joined)
        out = []
        for role, field in self.fields:
            text = _text(record.get(field))
            if added := _text(record.get(more.get(field, ""))):
                text = f"{text}\n\n{added}"
            if role == "user":
                out += _history(record.get("history"))
            if text or role != "system":
                out.append((role, text))
        return out


def _history(value) -> list[tuple[str, str]]:
    """The turns of a history; what is neither a pair nor an object with role and content is one turn, as JSON."""
    out, names = [], dict(ROLES)
    for x in value if isinstance(value, list) else [value] if value else []:
        if isinstance(x, list) and len(x) == 2:
            out += [("user", _text(x[0])), ("assistant", _text(x[1]))]
        elif isinstance(x, dict) and x.keys() == {"role", "content"}:
            out.append((names.get(r := _text(x["role"]), r), _text(x["content"])))
        else:
            out.append(("history", _text(x)))
    return out


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def texts_at(value, at: str = "") -> Iterator[str]:
    """The paths of all texts that aren't blank, but for those of metadata."""
    if isinstance(value, dict):
        for k, v in value.items():
            if k not in METADATA:
                yield from texts_at(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        for v in value:
            yield from texts_at(v, at + "[]")
    elif isinstance(value, str) and value.strip():
        yield at


LAYOUTS = (
    Layout("turns", ("turns[].role", "turns[].text"), ("turns", "role", "text")),
    Layout("messages", ("messages[].role", "messages[].content"), ("messages", "role", "content"), optional=("system", "messages[].tool_calls"), roles=ROLES, calls="tool_calls"),
    Layout("from_value", ("conversations[].from", "conversations[].value"), ("conversations", "from", "value"), optional=("system",), roles=ROLES),
    Layout("prompt", ("prompt", "response"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system", "history")),
    Layout("prompt_completion", ("prompt", "completion"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system", "history")),
    Layout("instruction", ("instruction", "output"), fields=(("system", "system"), ("user", "instruction"), ("assistant", "output")), joined=(("instruction", "input"),), optional=("input", "system", "history")),
)


class Mappings:
    """Layouts by fingerprint."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.layouts = layouts
        self.known = {p for x in layouts for p in (*x.paths, *x.optional)}
        self.by_hash = {h: x for x in reversed(layouts) for h in x.fingerprints}

    def layout(self, record: dict) -> Layout | None:
        paths = set(nested_paths(record))
        found = self.by_hash.get(path_hash(paths & self.known))
        if not found:  # fields of several layouts, or a list without any turn
            found = next((x for x in self.layouts if paths.issuperset(x.paths) or x.items and record.get(x.items[0]) == []), None)
        return found if found and all(map(found.names, set(texts_at(record)))) else None


def path_hash(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def nested_paths(value, at: str = "") -> Iterator[str]:
    """The paths of all fields below the top, those of lists and objects included."""
    if isinstance(value, dict):
        for k, v in value.items():
            path = f"{at}.{k}" if at else k
            yield path
            yield from nested_paths(v, path)
    elif isinstance(value, list):
        for v in value:
            yield from nested_paths(v, at + "[]")


def canonical(record: str | None, mappings: Mappings) -> tuple[str | None, list[tuple[str, str]]]:
    """The name of a record's layout and its turns."""
    if record is None:
        return None, []
    try:
        value = json.loads(record)
        layout = mappings.layout(value) if isinstance(value, dict) else None
    except (ValueError, RecursionError):
        layout = None
    return (layout.name, layout.turns(value)) if layout else (None, [("record", record)])


def escape(text: str) -> str:
    return ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return BACK.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """The formatted text, and the loss mask as start, end, start, end, ..."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[{escape(role)}]", escape(text)
        if role == LEARNED:
            spans += [at + len(head), at + len(head) + len(body)]
        out += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(a), unescape(b)) for a, b in TURN.findall(formatted)]


def format_chats(records: DataFrame, column: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records (conv_id and a JSON column) -> conv_id, layout, formatted, loss_spans."""
    mappings = Mappings(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [canonical(x, mappings) for x in part.column("text").to_pylist()]
            made = [format_turns(t) for _, t in found]
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array([n for n, _ in found], pa.string()), pa.array([a for a, _ in made], pa.string()), pa.array([b for _, b in made], pa.list_(pa.int64()))], names=["conv_id", "layout", "formatted", "loss_spans"])

    return records.select("conv_id", F.col(column).alias("text")).mapInArrow(run, "conv_id long, layout string, formatted string, loss_spans array<long>")


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted texts alone, and from their masks."""

    def one(text: str, spans: list[int]) -> tuple:
        turns = read_back(text)
        learned = unescape("".join(text[a:b] for a, b in zip(spans[::2], spans[1::2], strict=True)))
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for part in slices(batches, "formatted"):
            rows = [one(a or "", b or []) for a, b in zip(part.column("formatted").to_pylist(), part.column("loss_spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_records(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text rows -> conv_id and one JSON record per conversation, of one of four layouts, by its id, among those that can hold its roles.

    A conversation is one text in the end, so its turns meet in one row; nothing else is grouped."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = F.when(F.col("conv_id").cast("long").isNull(), F.monotonically_increasing_id()).alias("_own")
    each = rows.select("conv_id", "turn", "role", "text", own).groupBy(F.col("conv_id").cast("long").alias("conv_id"), "_own").agg(F.array_sort(F.collect_list(turn), _order).alias("t"))
    each = each.withColumn("roles", F.transform("t", lambda x: x["role"]))
    pairs = lambda role, text: F.transform("t", lambda x: F.struct(x["role"].alias(role), x["text"].alias(text)))
    text = lambda i: F.try_element_at("t", F.lit(i))["text"]
    pick, plain = F.pmod("conv_id", F.lit(4)), ~F.arrays_overlap("roles", F.array(*(F.lit(a) for a, _ in ROLES)))
    is_ = lambda *roles: F.col("roles") == F.array(*map(F.lit, roles))
    record = (
        F.when((pick == 1) & plain, F.to_json(F.struct(pairs("role", "content").alias("messages"))))
        .when((pick == 2) & plain, F.to_json(F.struct(pairs("from", "value").alias("conversations"))))
        .when((pick == 3) & is_("user", "assistant"), F.to_json(F.struct(text(1).alias("prompt"), text(2).alias("response"))))
        .when((pick == 3) & is_("system", "user", "assistant") & (text(1) != ""), F.to_json(F.struct(text(1).alias("system"), text(2).alias("prompt"), text(3).alias("response"))))
        .otherwise(F.to_json(F.struct(pairs("role", "text").alias("turns"))))
    )
    return each.select("conv_id", record.alias("record"))


def _order(a, b):
    """By turn (null first), then role, then text."""
    one = F.when(a["turn"].isNull() & b["turn"].isNull(), 0).when(a["turn"].isNull(), -1).when(b["turn"].isNull(), 1).when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(0)
    rest = F.when(a["role"] < b["role"], -1).when(a["role"] > b["role"], 1).when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0)
    return F.when(one != 0, one).otherwise(rest)


TRAP = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    return digest(format_chats(turn_records(rows.unionByName(trap))))


QUERIES = {"op4_chat_format": op4_chat_format}
SQL = {
    "op4_chat_format": r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '[\\<\[\]]', 'xx', 'g')) + length(regexp_replace(text, '[\\<\[\]]', 'xx', 'g')) + 9 AS chars, row_number() OVER () AS row_id FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN row_id END"""
}
