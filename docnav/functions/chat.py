"""Prompts, replies and traces of model calls as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docnav.functions.text import CAPTION, lines, strip

# Keys that change from call to call, and what stands for a page without a usable summary.
VOLATILE = ("timestamp", "run_id", "conversation_id", "metadata", "state")
FAILED_SUMMARY = "(summary agent failed; fallback to first line)"
IMAGE_SUMMARY = "struct<title: string, summary: string, keywords: array<string>, has_visual_elements: boolean>"


def fill(template: str, **parts: Column) -> Column:
    """A template with ``{name}`` replaced by columns; what the columns hold is not searched again."""
    out, rest = [], template
    while rest:
        places = sorted((rest.find("{" + n + "}"), n) for n in parts if "{" + n + "}" in rest)
        if not places:
            break
        at, name = places[0]
        out += [F.lit(rest[:at]), F.coalesce(parts[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*out, F.lit(rest))


def after_thinking(c: Column) -> Column:
    """What follows the first end of reasoning."""
    return strip(F.regexp_replace(c, "(?s)^.*?</think>", ""))


def caption_tokens(captions: Column) -> Column:
    """Search tokens of captions, such as figure1 and table12."""
    label = lambda c: F.when(F.lower(F.regexp_extract(c, CAPTION, 1)).startswith("tab"), "table").otherwise("figure")
    number = lambda c: F.regexp_extract(c, CAPTION, 2).cast("int").cast("string")
    return F.transform(F.filter(captions, lambda c: c.rlike(CAPTION)), lambda c: F.concat(label(c), number(c)))


def image_summary(reply: Column, page: Column) -> Column:
    """struct<title, summary, keywords, has_visual_elements> of a reply in JSON, with or without a fence around it; of any other reply its
    first line is the title, and all of it the summary."""
    bare = F.regexp_replace(F.regexp_replace(strip(reply), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    bare = F.when(strip(reply).startswith("```"), bare).otherwise(strip(reply))
    got = F.from_json(bare, IMAGE_SUMMARY)
    numbered = F.concat(F.lit("Page "), page.cast("string"))
    first = F.get(F.filter(F.transform(lines(bare), lambda x: F.regexp_replace(x, r"^[# *]+|[# *]+$", "")), lambda x: strip(x) != ""), F.lit(0))
    ok = bare.startswith("{") & got.isNotNull() & F.get_json_object(bare, "$").isNotNull()
    parsed = F.struct(F.coalesce(got["title"], numbered).alias("title"), F.coalesce(got["summary"], bare).alias("summary"), F.coalesce(got["keywords"], F.array().cast("array<string>")).alias("keywords"), F.coalesce(got["has_visual_elements"], F.lit(True)).alias("has_visual_elements"))
    plain = F.struct(F.substring(F.coalesce(first, numbered), 1, 120).alias("title"), F.substring(bare, 1, 600).alias("summary"), F.array().cast("array<string>").alias("keywords"), F.lit(True).alias("has_visual_elements"))
    return F.when(ok, parsed).otherwise(plain)


def chat_url(base: Column) -> Column:
    url = F.regexp_replace(base, "/+$", "")
    return F.when(url.endswith("/chat/completions"), url).when(url.endswith("/v1"), F.concat(url, F.lit("/chat/completions"))).otherwise(F.concat(url, F.lit("/v1/chat/completions")))


def models_url(base: Column) -> Column:
    url = F.regexp_replace(F.regexp_replace(base, "/+$", ""), "/chat/completions$", "")
    return F.concat(url, F.when(url.endswith("/v1"), "/models").otherwise("/v1/models"))


def data_uri(content: Column, kind: Column) -> Column:
    """Image bytes as a data URI; base64 in one line, whatever its length."""
    mime = F.when(F.upper(kind).isin("JPEG", "JPG"), "image/jpeg").otherwise("image/png")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def plan_markdown(plan: Column, more: Column | None = None) -> Column:
    """A plan as a Markdown list. ``plan`` has question_type, expected_answer_format, needs_visual_inspection, sub_goals, search_queries,
    candidate_sections and anchor_pages, any of which may be null; ``more`` is a map of further fields, of which those that begin with _ are left out."""
    bold = lambda name, text: F.concat(F.lit(f"- **{name}**: "), text)
    listed = lambda c, name, one=lambda x: x: F.when(F.size(plan[c]) > 0, bold(name, F.concat_ws(", ", F.transform(plan[c].cast("array<string>"), one))))
    known = plan["question_type"].isNotNull() | plan["expected_answer_format"].isNotNull()
    kind = F.concat(F.coalesce(plan["question_type"], F.lit("unspecified")), F.lit(" (Expected Format: "), F.coalesce(plan["expected_answer_format"], F.lit("unspecified")), F.lit(")"))
    goals = F.when(F.size(plan["sub_goals"]) > 0, F.concat(F.lit("- **Sub-goals**:\n"), F.concat_ws("\n", F.transform(plan["sub_goals"], lambda g: F.concat(F.lit("  - "), g)))))
    visual = plan["needs_visual_inspection"]
    parts = [
        F.when(known, bold("Question Type", kind)), F.when(visual.isNotNull(), bold("Needs Visual Inspection", F.initcap(visual.cast("string")))), goals,
        listed("search_queries", "Search Queries", lambda q: F.concat(F.lit("`"), q, F.lit("`"))), listed("candidate_sections", "Candidate Sections"), listed("anchor_pages", "Anchor Pages"),
    ]
    if more is not None:
        title = lambda k: F.initcap(F.replace(k, F.lit("_"), F.lit(" ")))
        kept = F.filter(F.map_entries(more), lambda e: ~e["key"].startswith("_"))
        parts.append(F.when(F.size(kept) > 0, F.concat_ws("\n", F.transform(kept, lambda e: F.concat(F.lit("- **"), title(e["key"]), F.lit("**: "), e["value"])))))
    return F.concat_ws("\n", *parts)


def system_text(parts: Column) -> Column:
    """The instructions of a call's messages as one leading system message: each once, in order."""
    return F.concat_ws("\n\n", F.array_distinct(F.filter(parts, lambda p: p.isNotNull() & (p != ""))))


MESSAGE = "struct<role: string, name: string, content: string, tool_call_id: string>"


def flatten(messages: Column) -> Column:
    """array of MESSAGE: system messages merged into one in front, the others in order. ``messages`` is an array of MESSAGE."""
    is_system = lambda m: m["role"] == "system"
    system = system_text(F.transform(F.filter(messages, is_system), lambda m: m["content"]))
    head = F.struct(F.lit("system").alias("role"), F.lit(None).cast("string").alias("name"), system.alias("content"), F.lit(None).cast("string").alias("tool_call_id"))
    rest = F.filter(messages, lambda m: ~is_system(m))
    return F.when(system != "", F.concat(F.array(head), rest)).otherwise(rest)


def redacted(c: Column) -> Column:
    """A trace's JSON with the data of binary parts replaced by its length."""
    found = F.regexp_extract_all(c, F.lit(r'"data"\s*:\s*"([A-Za-z0-9+/=]+)"'), F.lit(1))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    short = F.aggregate(found, c, lambda text, d: F.replace(text, quoted(d), quoted(F.concat(F.lit("<"), F.length(d).cast("string"), F.lit(" base64 chars>")))))
    return F.when(c.rlike(r'"kind"\s*:\s*"binary"'), short).otherwise(c)


def redacted_part(kind: Column, media: Column, data: Column) -> Column:
    """What a trace shows of one part of a message."""
    return F.when(kind == "binary", F.concat(F.lit("<"), F.length(data).cast("string"), F.lit(" base64 chars>"))).when(kind == "bytes", F.concat(F.lit("<"), media, F.lit(" "), F.length(data).cast("string"), F.lit(" bytes>"))).otherwise(data)


def usage(response: Column) -> Column:
    """struct<prompt_tokens, completion_tokens, cost> of a response struct<usage, provider_details>; the cost may stand in the provider's details, or be null."""
    cost = F.coalesce(response["usage"]["cost"], response["provider_details"]["cost"]).cast("double")
    return F.struct(response["usage"]["input_tokens"].cast("long").alias("prompt_tokens"), response["usage"]["output_tokens"].cast("long").alias("completion_tokens"), cost.alias("cost"))


def stable_key(fields: Column) -> Column:
    """SHA-256 of a map of call fields (values as JSON text) without the volatile ones, whatever the order of its keys."""
    kept = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*VOLATILE))
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(kept))), 256)


def sampling(settings: Column, thinking: bool, penalty: float = 0.0, scale: float = 1.0) -> Column:
    """A map of call settings with the sampling of thinking models in place of greedy decoding, if asked for, and max_tokens scaled."""
    out = settings
    if thinking:
        fixed = {"temperature": "0.6", "top_p": "0.95", "top_k": "20"} | ({"presence_penalty": str(penalty)} if penalty else {})
        fresh = F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv])
        out = F.map_concat(F.map_filter(out, lambda k, _: ~k.isin(*fixed)), fresh)
    if scale != 1.0:
        out = F.transform_values(out, lambda k, v: F.when(k == "max_tokens", F.floor(v.cast("double") * scale).cast("string")).otherwise(v))
    return out


def form_data(options: dict) -> dict[str, str]:
    """Options of a parsing service as form fields: without nulls, booleans as words."""
    return {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if v is not None}
