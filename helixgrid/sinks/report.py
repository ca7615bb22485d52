"""The dashboard: summary JSON files of all modules on one HTML page that needs no network."""

from __future__ import annotations

import json
from html import escape
from pathlib import Path

#: What a summary file's name ends with. Fixed values.
SUFFIXES = (".fastq.summary.json", ".align.summary.json", ".dna.summary.json", ".contamination.json", ".rna.summary.json")
HEAVY = ("kmers", "per_base")
HEAVY_START = ("overrepresented",)


def find_summaries(inputs: list[str]) -> list[Path]:
    """Files as they are, prefixes with each suffix, folders with all their summaries; each file once."""
    found: list[Path] = []
    for i in inputs:
        p = Path(i)
        if p.is_file():
            found.append(p)
        elif p.is_dir():
            found += sorted(x for x in p.iterdir() if x.name.endswith(SUFFIXES))
        else:
            found += [q for s in SUFFIXES if (q := Path(i + s)).is_file()]
    return list({p.resolve(): p for p in found}.values())


def prune(value: object) -> object:
    """Without lists too heavy for a page, at any depth."""
    if isinstance(value, dict):
        return {k: prune(v) for k, v in value.items() if k not in HEAVY and not k.startswith(HEAVY_START)}
    return [prune(v) for v in value] if isinstance(value, list) else value


def document(path: Path) -> dict:
    """module, sample, source, metrics; module and sample from the file's name where it has no envelope."""
    data = json.loads(path.read_text())
    name = next((s for s in SUFFIXES if path.name.endswith(s)), ".json")
    module = name.strip(".").split(".")[0] if name != ".json" else "unknown"
    enveloped = isinstance(data, dict) and "metrics" in data
    return {"module": data.get("module", module) if enveloped else module, "sample": data.get("sample", path.name.removesuffix(name)) if enveloped else path.name.removesuffix(name), "source": str(path), "metrics": prune(data["metrics"] if enveloped else data)}


def flatten(value: object, prefix: str = "") -> list[tuple[str, str]]:
    """Scalars of nested metrics as (dotted name, text); lists by their length."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flatten(v, f"{prefix}.{k}" if prefix else str(k))]
    if isinstance(value, list):
        return [(prefix, f"{len(value)} values")]
    return [(prefix, "NA" if value is None else f"{value:.4g}" if isinstance(value, float) else str(value))]


def render(documents: list[dict], images: list[tuple[str, str]] = ()) -> str:
    """One section per module, a column per sample; images: (title, svg). Percentages are shown as they are stored."""
    sections = []
    for module in dict.fromkeys(d["module"] for d in documents):
        own = [d for d in documents if d["module"] == module]
        cells = [dict(flatten(d["metrics"])) for d in own]
        names = list(dict.fromkeys(n for c in cells for n in c))
        head = "".join(f"<th>{escape(d['sample'])}</th>" for d in own)
        rows = "".join(f"<tr><td>{escape(n)}</td>" + "".join(f"<td>{escape(c.get(n, ''))}</td>" for c in cells) + "</tr>" for n in names)
        sections.append(f"<section id='{escape(module)}'><h2>{escape(module)}</h2><table><tr><th>metric</th>{head}</tr>{rows}</table></section>")
    figures = "".join(f"<figure><figcaption>{escape(t)}</figcaption>{svg}</figure>" for t, svg in images)
    tabs = "".join(f"<a href='#{escape(m)}'>{escape(m)}</a> " for m in dict.fromkeys(d["module"] for d in documents))
    data = json.dumps(documents, default=str).replace("<", "\\u003c")
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ddd;padding:.3em .6em;text-align:left}"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Sequencing QC</title><style>{style}</style></head><body><h1>Sequencing QC</h1><nav>{tabs}</nav>{''.join(sections)}{figures}<script type='application/json' id='data'>{data}</script></body></html>"


def write_report(inputs: list[str], prefix: str, images: list[tuple[str, str]] = ()) -> tuple[Path, Path]:
    """<prefix>.report.json and <prefix>.report.html."""
    documents = [document(p) for p in find_summaries(inputs)]
    as_json, as_html = Path(f"{prefix}.report.json"), Path(f"{prefix}.report.html")
    as_json.write_text(json.dumps({"documents": documents}, indent=2))
    as_html.write_text(render(documents, images))
    return as_json, as_html
