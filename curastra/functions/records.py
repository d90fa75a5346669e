"""Functions on records: licences, build scripts, review answers, model responses, tool calls."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze, strip

#: Licences that may be used; build scripts in order; scripts that aren't builds.
ALLOWED_LICENSES = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0"]
BUILD_SCRIPTS = ["build", "build:prod", "compile", "bundle"]
OTHER_SCRIPTS = ["test", "lint", "format", "dev", "serve", "start", "preview"]
#: Names of licence files in order.
LICENSE_FILES = ["LICENSE", "LICENSE.md", "LICENSE.txt", "LICENCE", "LICENCE.md", "COPYING"]
#: The reason given where labels were recovered; the checks of a review.
RECOVERED = "reviewer output truncated after explicit labels"
CHECKS = ["alignment", "granularity_match", "solvability"]
#: Longest time a command may take.
MAX_TIMEOUT_MS = 30_000


#: Words of licence texts.
APACHE = "apache license", "version 2.0"
BSD, BSD_THIRD = "redistribution and use in source and binary forms", ("neither the name", "names of its contributors")
MIT = "permission is hereby granted, free of charge", 'the software is provided "as is"'


def detect_license(text: Column) -> Column:
    """SPDX id of a licence text, or UNKNOWN; the order decides where several fit."""
    t = squeeze(F.lower(text))
    has = lambda *parts: reduce(and_, map(t.contains, parts))
    bsd, three = has(BSD), reduce(or_, map(t.contains, BSD_THIRD))
    return (
        F.when(has(*APACHE), "Apache-2.0")
        .when(bsd & three, "BSD-3-Clause")
        .when(bsd, "BSD-2-Clause")
        .when(has(*MIT), "MIT")
        .otherwise("UNKNOWN")
    )


def first_license_file(names: Column) -> Column:
    """The first of the usual licence files among a repository's top-level names."""
    return F.get(F.array_intersect(F.array(*map(F.lit, LICENSE_FILES)), names), F.lit(0))


def choose_build_script(scripts: Column) -> Column:
    """Of a map of scripts: a usual name, else the smallest other with "build" in it."""
    have = F.map_keys(F.map_filter(scripts, lambda _, v: v.isNotNull()))
    usual = F.get(F.array_intersect(F.array(*map(F.lit, BUILD_SCRIPTS)), have), F.lit(0))
    other = F.array_min(F.filter(have, lambda k: k.contains("build") & ~k.isin(*OTHER_SCRIPTS)))
    return F.coalesce(usual, other)


def parse_review(raw: Column) -> Column:
    """struct of the checks, ``reason``, ``parse_mode`` and ``parse_valid`` of a reviewer's answer.

    The widest {...} is read as JSON, labels lower-cased. If that isn't a JSON object, labels
    are recovered from the text, but only if all three are there. ``parse_valid`` says that
    all are pass or fail; missing ones are "invalid".
    """
    found = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    object_ = F.when((found != "") & F.try_parse_json(found).isNotNull(), found)
    from_json = [F.lower(F.get_json_object(object_, f"$.{c}")) for c in CHECKS]
    label = [F.lower(F.nullif(F.regexp_extract(raw, rf'(?i)"{c}"\s*:\s*"(pass|fail)"', 1), F.lit(""))) for c in CHECKS]
    all_there = label[0].isNotNull() & label[1].isNotNull() & label[2].isNotNull()
    mode = F.when(object_.isNotNull(), "json").when(all_there, "recovered_explicit_labels").otherwise("invalid")
    value = [F.coalesce(F.when(mode == "json", j).when(mode == "recovered_explicit_labels", x), F.lit("invalid")) for j, x in zip(from_json, label, strict=True)]
    reason = F.when(mode == "json", F.coalesce(F.get_json_object(object_, "$.reason"), F.lit(""))).when(mode == "recovered_explicit_labels", RECOVERED).otherwise("")
    valid = value[0].isin("pass", "fail") & value[1].isin("pass", "fail") & value[2].isin("pass", "fail")
    return F.struct(*(v.alias(c) for v, c in zip(value, CHECKS, strict=True)), reason.alias("reason"), mode.alias("parse_mode"), valid.alias("parse_valid"))


def http_error_code(body: Column) -> Column:
    """``error.code`` of a JSON body, else null."""
    return F.get_json_object(body, "$.error.code")


def output_text(body: Column) -> Column:
    """The ``output_text`` parts of a model response, joined by line feeds; null without any."""
    kind = "struct<output:array<struct<content:array<struct<type:string,text:string>>>>>"
    parts = F.flatten(F.transform(F.from_json(body, kind)["output"], lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "output_text") & p["text"].isNotNull()), lambda p: p["text"])
    return F.when(F.size(texts) > 0, F.array_join(texts, "\n"))


def final_answer(text: Column) -> Column:
    """struct(status, message) of a text that begins with SUCCESS: or FAILURE:, else null."""
    t = strip(text)
    of = lambda status: F.struct(F.lit(status).alias("status"), strip(t.substr(F.lit(9), F.length(t))).alias("message"))
    return F.when(t.startswith("SUCCESS:"), of("success")).when(t.startswith("FAILURE:"), of("failure"))


def valid_tool_call(call: Column) -> Column:
    """Whether a JSON tool call is of a known tool, with its keys only and values in range."""
    keys = F.array_sort(F.json_object_keys(call))
    get = lambda k: F.get_json_object(call, f"$.{k}")
    kind = F.schema_of_variant(F.try_parse_json(call))
    is_string = lambda k: kind.rlike(rf"[<, ]{k}: STRING")
    named = lambda k: is_string(k) & (strip(get(k)) != "")
    only = lambda *names: F.size(F.array_except(keys, F.array(*map(F.lit, names)))) == 0
    tool = get("tool")
    timeout = get("timeoutMs")
    in_time = timeout.isNull() | (timeout.rlike("^[0-9]+$") & ~is_string("timeoutMs") & F.coalesce(timeout.try_cast("bigint").between(1, MAX_TIMEOUT_MS), F.lit(False)))
    ok = (
        F.when(tool == "read_file", only("tool", "path") & named("path"))
        .when(tool == "write_file", only("tool", "path", "content") & named("path") & is_string("content"))
        .when(tool == "run_command", only("tool", "command", "args", "timeoutMs") & named("command") & kind.rlike(r"[<, ]args: ARRAY<(STRING|VOID)>") & in_time)
        .otherwise(False)
    )
    return F.coalesce(ok, F.lit(False))


def inside_workspace(path: Column) -> Column:
    """Whether a path is relative and never climbs: the part of the guard that needs no disk."""
    parts = F.split(path, r"[/\\]")
    return ~path.rlike(r"^(/|\\|[A-Za-z]:)") & ~F.array_contains(parts, "..") & (path != "")
