"""Wire-format adapters: a frame of text to an array of parsed chunks, as Column expressions.

A chunk has a ``kind`` (content, done, empty, passthrough or error) and the fields that go with it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META = "struct<id:string,model:string,idx:int,created:bigint,event_type:string>"
CHUNK = f"struct<kind:string,text:string,finish_reason:string,payload:string,meta:{META}>"


def chunk(kind: str, text: Column | None = None, finish_reason: Column | None = None, payload: Column | None = None, meta: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"), (none if text is None else text).cast("string").alias("text"), (none if finish_reason is None else finish_reason).cast("string").alias("finish_reason"),
        (none if payload is None else payload).cast("string").alias("payload"), (none if meta is None else meta).cast(META).alias("meta"),
    ).cast(CHUNK)


def meta(json: Column | None = None, event: Column | None = None) -> Column:
    get = (lambda p: F.get_json_object(json, p)) if json is not None else (lambda p: F.lit(None))
    return F.struct(
        get("$.id").cast("string").alias("id"), get("$.model").cast("string").alias("model"), F.coalesce(get("$.choices[0].index").cast("int"), F.lit(0)).alias("idx"),
        get("$.created").cast("bigint").alias("created"), (F.lit(None) if event is None else event).cast("string").alias("event_type"),
    )


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def json_path(path: str) -> str:
    """``a.b[0].c`` as a JSON path."""
    return "$." + path


def text_at(json: Column, path: str) -> Column:
    """The string at a dotted path; null for anything but a string."""
    leaf = F.try_variant_get(F.try_parse_json(json), json_path(path), "variant")
    return F.when(F.schema_of_variant(leaf) == "STRING", F.get_json_object(json, json_path(path)))


def decoded(frames: DataFrame, column: str, into: str) -> DataFrame:
    """Frames of bytes as text; what is no UTF-8 becomes a replacement character."""
    return frames.withColumn(into, F.make_valid_utf8(F.col(column).cast("string"))).drop(column)


def lines(frame: Column) -> Column:
    return F.filter(F.transform(F.split(frame, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


class OpenAi:
    """``data:`` lines of chat-completion chunks; a finish reason comes before content."""

    name, content_type = "openai", "text/event-stream"

    def __init__(self, preserve_tool_calls: bool = True):
        self.preserve_tool_calls = preserve_tool_calls

    def is_done(self, text: Column) -> Column:
        return F.trim(text).isin("data: [DONE]", "[DONE]")

    def one(self, json: Column) -> Column:
        get = lambda p: F.get_json_object(json, p)
        shape = lambda p: F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), p, "variant"))
        bad = ~is_json(json) | ~F.coalesce(shape("$.choices").startswith("ARRAY"), F.lit(False)) | (get("$.choices[0]").isNotNull() & get("$.choices[0].delta").isNull())
        ends = chunk("done", finish_reason=get("$.choices[0].finish_reason"), meta=meta(json))
        out = F.when(bad, chunk("error", payload=json)).when(get("$.choices[0].finish_reason").isNotNull(), ends)
        out = out.when(F.coalesce(get("$.choices[0].delta.content"), F.lit("")) != "", chunk("content", get("$.choices[0].delta.content"), meta=meta(json)))
        if self.preserve_tool_calls:
            out = out.when(get("$.choices[0].delta.tool_calls").isNotNull(), chunk("passthrough", payload=json))
        return out.otherwise(chunk("empty"))

    def parse(self, frame: Column) -> Column:
        data = F.filter(lines(frame), lambda x: self.is_done(x) | (x.startswith("data:") & (F.trim(F.substring(x, 6, 2**31 - 1)) != "")))
        body = lambda x: F.trim(F.substring(x, 6, 2**31 - 1))
        return F.transform(data, lambda x: F.when(self.is_done(x) | (body(x) == "[DONE]"), chunk("done")).otherwise(self.one(body(x))))


@dataclass
class Configured:
    """SSE or newline-delimited JSON with paths from configuration."""

    name: str
    format: str = "sse"
    content_path: str = "content"
    done_marker: str | None = None
    content_events: list[str] = field(default_factory=list)
    finish_reason_path: str | None = None

    @property
    def lined(self) -> bool:
        return self.format in ("ndjson", "jsonl")

    @property
    def content_type(self) -> str:
        return "application/x-ndjson" if self.lined else "text/event-stream"

    def is_done(self, text: Column) -> Column:
        return text.contains(self.done_marker) if self.done_marker is not None else F.lit(False)

    def one(self, json: Column, event: Column | None) -> Column:
        """Array of the chunk that a JSON text gives: done, content or nothing."""
        nothing = F.array().cast(f"array<{CHUNK}>")
        text = text_at(json, self.content_path)
        found = F.when(F.coalesce(text, F.lit("")) != "", F.array(chunk("content", text, meta=meta(event=event)))).otherwise(nothing)
        if self.finish_reason_path:
            reason = text_at(json, self.finish_reason_path)
            found = F.when(F.coalesce(reason, F.lit("")) != "", F.array(chunk("done", finish_reason=reason))).otherwise(found)
        return found

    def parse(self, frame: Column) -> Column:
        if self.lined:
            return F.flatten(F.transform(lines(frame), lambda x: F.when(self.is_done(x), F.array(chunk("done"))).otherwise(self.one(x, None))))
        nothing = F.array().cast(f"array<{CHUNK}>")
        start = F.struct(F.lit(None).cast("string").alias("event"), nothing.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            body, is_event = F.trim(F.substring(x, 6, 2**31 - 1)), x.startswith("event:")
            event = F.when(~self.is_done(x) & is_event, F.trim(F.substring(x, 7, 2**31 - 1))).otherwise(acc["event"])
            data = self.one(body, acc["event"])
            if self.content_events:
                other = acc["event"].isNotNull() & ~acc["event"].isin(self.content_events)
                data = F.when(other, F.array(chunk("passthrough", payload=body))).otherwise(data)
            more = F.when(self.is_done(x), F.array(chunk("done"))).when(~is_event & x.startswith("data:") & (body != ""), data).otherwise(nothing)
            return F.struct(event.alias("event"), F.concat(acc["out"], more).alias("out"))

        return F.aggregate(lines(frame), start, step)["out"]


def anthropic() -> Configured:
    return Configured("anthropic", "sse", "delta.text", "message_stop", ["content_block_delta"])


class Registry:
    """Adapters by name; an unknown name is the chat-completion format."""

    def __init__(self) -> None:
        self._makers: dict[str, Callable[[], OpenAi | Configured]] = {}

    def register(self, name: str, maker: Callable[[], OpenAi | Configured]) -> None:
        self._makers[name] = maker

    def get(self, spec: str | dict | None) -> OpenAi | Configured:
        if isinstance(spec, dict):
            known = {k: v for k, v in spec.items() if k in Configured.__dataclass_fields__}
            return Configured(**{"name": "custom", **known})
        return self._makers.get(spec or "openai", OpenAi)()

    def list(self) -> list[str]:
        return sorted(self._makers)


def default_registry() -> Registry:
    r = Registry()
    for name, maker in (("openai", OpenAi), ("openai_sse", OpenAi), ("anthropic", anthropic)):
        r.register(name, maker)
    return r


def parse_frames(frames: DataFrame, adapter: OpenAi | Configured, frame: str = "frame") -> DataFrame:
    """One row per chunk with its place ``pos`` in the frame; works on streams too."""
    keep = [c for c in frames.columns if c != frame]
    return frames.select(*keep, F.posexplode(adapter.parse(F.col(frame))).alias("pos", "c")).select(*keep, "pos", "c.*")


def parse_mixed(frames: DataFrame, registry: Registry, fmt: str = "format", frame: str = "frame") -> DataFrame:
    """Frames of several formats, named by a column."""
    out = None
    for name in registry.list():
        parsed = registry.get(name).parse(F.col(frame))
        out = F.when(F.col(fmt) == name, parsed) if out is None else out.when(F.col(fmt) == name, parsed)
    assert out is not None
    keep = [c for c in frames.columns if c != frame]
    return frames.select(*keep, F.posexplode(out.otherwise(registry.get(None).parse(F.col(frame)))).alias("pos", "c")).select(*keep, "pos", "c.*")
