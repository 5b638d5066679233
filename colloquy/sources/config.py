"""Driver configuration: a small YAML subset, precedence, checks."""

from __future__ import annotations

from typing import Any


def _strip_comment(line: str) -> str:
    quote = ""
    for n, ch in enumerate(line):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch == "#" and (n == 0 or line[n - 1].isspace()):
            return line[:n]
    return line


def scalar(text: str) -> Any:
    """null, booleans, numbers, inline lists, quoted or plain strings."""
    t = text.strip()
    if t in ("", "~") or t.lower() in ("null", "none"):
        return None
    if t.lower() in ("true", "yes", "on"):
        return True
    if t.lower() in ("false", "no", "off"):
        return False
    if len(t) >= 2 and t[0] == t[-1] and t[0] in "'\"":
        return t[1:-1]
    if t[0] == "[" and t[-1] == "]":
        return [scalar(x) for x in t[1:-1].split(",")] if t[1:-1].strip() else []
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    return t


def parse(text: str) -> dict[str, Any]:
    """Nested mappings and lists of scalars or one-level mappings, by indentation."""
    lines = [(len(s) - len(s.lstrip()), s.strip()) for s in map(_strip_comment, text.splitlines()) if s.strip() and s.strip() != "---"]

    def block(at: int, indent: int) -> tuple[Any, int]:
        if lines[at][1].startswith("- ") or lines[at][1] == "-":
            out: list[Any] = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("-"):
                out.append(scalar(lines[at][1][1:]))
                at += 1
            return out, at
        made: dict[str, Any] = {}
        while at < len(lines) and lines[at][0] == indent:
            key, _, rest = lines[at][1].partition(":")
            at += 1
            if rest.strip():
                made[key.strip()] = scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("-"))):
                made[key.strip()], at = block(at, lines[at][0])
            else:
                made[key.strip()] = None
        return made, at

    return block(0, lines[0][0])[0] if lines else {}


def dump(value: dict[str, Any], indent: int = 0) -> str:
    """The same subset as text; parse(dump(x)) is x."""

    def plain(v: Any) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, str):
            return f'"{v}"' if v == "" or scalar(v) != v or v != v.strip() or any(c in v for c in ":#[],") else v
        return repr(v)

    out = []
    pad = " " * indent
    for k, v in value.items():
        if isinstance(v, dict):
            out.append(f"{pad}{k}:\n{dump(v, indent + 2)}" if v else f"{pad}{k}: null")
        elif isinstance(v, list):
            out.append(f"{pad}{k}:" + "".join(f"\n{pad}  - {plain(x)}" for x in v) if v else f"{pad}{k}: []")
        else:
            out.append(f"{pad}{k}: {plain(v)}")
    return "\n".join(out)


def layered(*levels: dict[str, Any]) -> dict[str, Any]:
    """Later levels win, key by key through nested mappings; None does not override."""
    out: dict[str, Any] = {}
    for level in levels:
        for k, v in level.items():
            if isinstance(v, dict) and isinstance(out.get(k), dict):
                out[k] = layered(out[k], v)
            elif v is not None or k not in out:
                out[k] = v
    return out


def experiments(base: dict[str, Any], items: list[dict[str, Any]]) -> dict[str, str]:
    """The configuration text of every experiment by name: the base under the item's overrides, with the
    output folder of the experiment."""
    made = {}
    for item in items:
        own = layered(base, item.get("overrides") or {}, {"output": {"folder": f"{(base.get('output') or {}).get('folder', 'runs')}/{item['name']}"}})
        made[item["name"]] = dump(own) + "\n"
    return made


def select(items: list[dict[str, Any]], only: list[str]) -> list[dict[str, Any]]:
    """Items whose name or group is asked for, all if nothing is; unknown names are an error."""
    known = {x["name"] for x in items} | {x.get("group") for x in items}
    if unknown := [n for n in only if n not in known]:
        raise ValueError(f"unknown: {', '.join(unknown)}")
    return [x for x in items if not only or x["name"] in only or x.get("group") in only]


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def check_sft(config: dict[str, Any]) -> None:
    """The rules of a fine-tuning configuration; the first one broken is an error."""
    model, data, training, lora = (config.get(k) or {} for k in ("model", "data", "training", "lora"))
    _need(bool(model.get("base_model")), "model.base_model is required")
    _need(bool(data.get("train_file") or data.get("hf_dataset_name")), "data.train_file or data.hf_dataset_name is required")
    _need((training.get("max_seq_length") or 0) > 0, "training.max_seq_length must be positive")
    _need((lora.get("rank") or 0) > 0, "lora.rank must be positive")
    _need(0 <= (data.get("validation_split_ratio") or 0) < 1, "data.validation_split_ratio must be in [0, 1)")
    _need((data.get("validation_split_size") or 0) >= 0, "data.validation_split_size must not be negative")
    _need(data.get("chat_template") in ("qwen3_nothink", "chatml"), "data.chat_template must be qwen3_nothink or chatml")


def check_dpo(config: dict[str, Any]) -> None:
    """The rules of a preference-training configuration."""
    _need(bool((config.get("data") or {}).get("train_file")), "data.train_file is required")
    _need(((config.get("dpo") or {}).get("beta") or 0) > 0, "dpo.beta must be positive")
