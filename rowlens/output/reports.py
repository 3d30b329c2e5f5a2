"""A result as text for a terminal, as markdown and as one HTML page."""

from __future__ import annotations

import html
import json

from rowlens.plans.schema import SchemaDiff
from rowlens.result import Result

_ROWS = (("added", "Added"), ("removed", "Removed"), ("changed", "Changed"), ("within_tolerance", "Within tolerance"), ("unchanged", "Unchanged"))


def percent(part: float, whole: float) -> str:
    """A share that never reads as nothing or all when it is neither."""
    if not whole:
        return "0%"
    p = 100 * part / whole
    if 0 < p < 0.01:
        return "<0.01%"
    if 99.99 < p < 100:
        return ">99.99%"
    return f"{p:.2f}".rstrip("0").rstrip(".") + "%"


def columns_by_change(r: Result) -> list[tuple[str, dict]]:
    return sorted(r.column_stats.items(), key=lambda x: (-x[1]["changed"], x[0]))


def schema_lines(s: SchemaDiff) -> list[str]:
    out = [f"+ {c['name']} {c['type']}" for c in s.added_columns] + [f"- {c['name']} {c['type']}" for c in s.removed_columns]
    out += [f"~ {c['column']}: {c['left']} -> {c['right']}" + ("" if c["comparable"] else " (not compared)") for c in s.type_changes]
    yes = {True: "nullable", False: "required"}
    out += [f"~ {c['column']}: {yes[c['left_nullable']]} -> {yes[c['right_nullable']]}" for c in s.nullability_changes]
    return out + [f"= {c['right']} renamed to {c['left']}" for c in s.renames]


def human_schema(s: SchemaDiff) -> str:
    lines = schema_lines(s)
    return "\n".join(["Schemas match." if s.same else "Schemas differ:", *(f"  {x}" for x in lines)])


def verdict(r: Result) -> str:
    return "identical" if r.same else "stopped: " + r.abort_reason if r.aborted else "rows match, schemas differ" if r.rows_same else "different"


def human(r: Result, limit: int = 10, verbose: bool = False) -> str:
    out = [f"Verdict: {verdict(r)}", human_schema(r.schema), f"Rows: {r.left_rows} left, {r.right_rows} right"]
    if r.filter:
        out.append(f"Filter: {r.filter}")
    if r.comparison:
        out.append(f"Compared: {r.comparison}")
    whole = max(r.left_rows, r.right_rows)
    out += [f"  {label:<17}{getattr(r, name):>12}  {percent(getattr(r, name), whole)}" for name, label in _ROWS if name != "within_tolerance" or r.within_tolerance]
    for name, label in (("dups_left", "repeated keys dropped, left"), ("dups_right", "repeated keys dropped, right"), ("dup_keys", "keys that repeat"), ("dup_rows", "rows under them")):
        if getattr(r, name):
            out.append(f"  {label}: {getattr(r, name)}")
    if r.column_stats:
        out.append("Columns:")
        for name, s in columns_by_change(r):
            size = f", largest difference {s['max_abs_diff']:g}, mean {s['mean_abs_diff']:g}" if s["numeric"] and s["max_abs_diff"] is not None else ""
            out.append(f"  {name}: {s['changed']} changed, {percent(s['match_rate'], 1)} match{size}")
    for title, keys, total in (("Added", r.added_examples, r.added), ("Removed", r.removed_examples, r.removed)):
        if keys:
            shown = keys if verbose else keys[:limit]
            out += [f"{title}:", *(f"  {k}" for k in shown)] + ([f"  ... and {total - len(shown)} more"] if total > len(shown) else [])
    if r.changed_examples:
        shown = r.changed_examples if verbose else r.changed_examples[:limit]
        out.append("Changed:")
        out += [f"  {e['key']}: " + ", ".join(f"{c['column']} {c['left']} -> {c['right']}" for c in e["columns"]) for e in shown]
        out += [f"  ... and {r.changed - len(shown)} more"] if r.changed > len(shown) else []
    return "\n".join(out)


def _cell(x) -> str:
    return str("NULL" if x is None else x).replace("\\", "\\\\").replace("|", "\\|").replace("`", "\\`").replace("<", "&lt;").replace("\r", " ").replace("\n", " ")


def markdown(r: Result, limit: int = 10) -> str:
    out = [f"## Comparison: {verdict(r)}", ""]
    if lines := schema_lines(r.schema):
        out += ["### Schema", "", *(f"- {_cell(x)}" for x in lines), ""]
    out += ["| Rows | Count |", "|---|---:|", f"| Left | {r.left_rows} |", f"| Right | {r.right_rows} |", *(f"| {label} | {getattr(r, name)} |" for name, label in _ROWS), ""]
    if r.column_stats:
        out += ["| Column | Changed | Match | Max difference | Mean difference |", "|---|---:|---:|---:|---:|"]
        num = lambda x: "" if x is None else f"{x:g}"
        out += [f"| {_cell(n)} | {s['changed']} | {percent(s['match_rate'], 1)} | {num(s['max_abs_diff'])} | {num(s['mean_abs_diff'])} |" for n, s in columns_by_change(r)] + [""]
    for title, keys in (("Added", r.added_examples), ("Removed", r.removed_examples)):
        if keys:
            out += [f"<details><summary>{title} examples</summary>", "", *(f"- {_cell(k)}" for k in keys[:limit]), "", "</details>", ""]
    if r.changed_examples:
        out += ["<details><summary>Changed examples</summary>", "", "| Key | Column | Left | Right |", "|---|---|---|---|"]
        out += [f"| {_cell(e['key'])} | {_cell(c['column'])} | {_cell(c['left'])} | {_cell(c['right'])} |" for e in r.changed_examples[:limit] for c in e["columns"]]
        out += ["", "</details>", ""]
    return "\n".join(out)


_PAGE = """<!doctype html><html lang="en"><meta charset="utf-8"><title>Comparison</title>
<style>:root{{color-scheme:light dark}}body{{font:15px system-ui;max-width:70em;margin:2em auto;padding:0 1em}}
table{{border-collapse:collapse;margin:1em 0}}th,td{{border-bottom:1px solid #8886;padding:.3em .8em;text-align:left}}th{{cursor:pointer}}</style>
<h1>Comparison: {verdict}</h1>{schema}{tables}
<script>document.querySelectorAll("th").forEach(h=>h.onclick=()=>{{const t=h.closest("table"),b=t.tBodies[0],i=h.cellIndex,d=h.dataset.d=h.dataset.d==1?-1:1;
[...b.rows].sort((x,y)=>d*x.cells[i].innerText.localeCompare(y.cells[i].innerText,undefined,{{numeric:true}})).forEach(r=>b.append(r))}})</script></html>"""


def _table(head: list[str], rows: list[list]) -> str:
    e = lambda x: html.escape("NULL" if x is None else f"{x:g}" if isinstance(x, float) else str(x))
    return "<table><thead><tr>" + "".join(f"<th>{e(h)}</th>" for h in head) + "</tr></thead><tbody>" + "".join("<tr>" + "".join(f"<td>{e(c)}</td>" for c in r) + "</tr>" for r in rows) + "</tbody></table>"


def page(r: Result) -> str:
    """One self-contained page with sortable tables."""
    tables = _table(["Rows", "Count"], [["Left", r.left_rows], ["Right", r.right_rows], *([label, getattr(r, name)] for name, label in _ROWS)])
    if r.column_stats:
        tables += "<h2>Columns</h2>" + _table(["Column", "Changed", "Match", "Max difference", "Mean difference"], [[n, s["changed"], percent(s["match_rate"], 1), s["max_abs_diff"], s["mean_abs_diff"]] for n, s in columns_by_change(r)])
    for title, keys in (("Added", r.added_examples), ("Removed", r.removed_examples)):
        tables += f"<h2>{title}</h2>" + _table(["Key"], [[k] for k in keys]) if keys else ""
    if r.changed_examples:
        tables += "<h2>Changed</h2>" + _table(["Key", "Column", "Left", "Right"], [[e["key"], c["column"], c["left"], c["right"]] for e in r.changed_examples for c in e["columns"]])
    lines = schema_lines(r.schema)
    schema = "<h2>Schema</h2><ul>" + "".join(f"<li>{html.escape(x)}</li>" for x in lines) + "</ul>" if lines else ""
    return _PAGE.format(verdict=html.escape(verdict(r)), schema=schema, tables=tables)


def write_report(r: Result, path: str, limit: int = 10) -> None:
    """HTML by its extension, markdown otherwise."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(page(r) if path.lower().endswith((".html", ".htm")) else markdown(r, limit))


def schema_json(s: SchemaDiff) -> str:
    return json.dumps({"equal": s.same, **s.as_dict()}, indent=2, ensure_ascii=False)
