"""Access views: a reader sees granted folders under aliases of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import paths


class AccessError(ValueError):
    pass


def check(grants: list[dict]) -> list[dict]:
    """Grants (root, alias, rights ro or rw, state live, dormant or revoked) with aliases filled in; refuses clashes and overlaps."""
    out: list[dict] = []
    for g in grants:
        root = "/" + g["root"].strip("/")
        alias = g.get("alias") or root.rsplit("/", 1)[1]
        if root == "/":
            raise AccessError("the root can't be shared")
        if not alias or "/" in alias or alias in (".", ".."):
            raise AccessError(f"{alias} is no alias")
        if any(o["alias"] == alias for o in out):
            raise AccessError(f"the alias {alias} is taken")
        state = g.get("state", "live")
        if state != "revoked" and any(o["state"] != "revoked" and (f"{o['root']}/".startswith(f"{root}/") or f"{root}/".startswith(f"{o['root']}/")) for o in out):
            raise AccessError(f"{root} overlaps another share")
        out.append({"root": root, "alias": alias, "rights": g.get("rights", "ro"), "state": state})
    return out


def to_store(grants: list[dict], path: str, write: bool = False) -> str:
    """The store path of a view path."""
    alias, _, rest = path.strip("/").partition("/")
    g = next((g for g in check(grants) if g["alias"] == alias), None)
    if g is None:
        raise AccessError("not found")
    if g["state"] != "live" or write and g["rights"] != "rw":
        raise AccessError("forbidden")
    return g["root"] + (f"/{rest}" if rest else "")


def view(files: DataFrame, grants: list[dict]) -> DataFrame:
    """files that live grants show, at their view paths, with share and rights; the filter is a union of prefixes."""
    p, shown, share, rights, path = F.col("path"), F.lit(False), None, None, None
    for g in (g for g in check(grants) if g["state"] == "live"):
        inside = (p == g["root"]) | paths.under(p, g["root"])
        shown = shown | inside
        new = F.concat(F.lit(f"/{g['alias']}"), F.substring(p, len(g["root"]) + 1, 1 << 30))
        share, rights, path = (F.when(inside, v) if old is None else old.when(inside, v) for old, v in ((share, F.lit(g["alias"])), (rights, F.lit(g["rights"])), (path, new)))
    if path is None:
        return files.limit(0).withColumns({"share": F.lit(None).cast("string"), "rights": F.lit(None).cast("string")})
    return files.where(shown).withColumns({"share": share, "rights": rights, "path": path})


def project_links(text: str, spans: list[dict], grants: list[dict], scheme: str = "node") -> str:
    """text as a reader sees it: recorded target spans (at, target, resolved, resolved_id) that leave the view become scheme:ID."""
    shown = [g["root"] for g in check(grants) if g["state"] == "live"]
    for s in sorted((s for s in spans if s["at"] >= 0 and s.get("resolved")), key=lambda s: -s["at"]):
        if not any(s["resolved"] == r or s["resolved"].startswith(r + "/") for r in shown):
            text = text[: s["at"]] + f"{scheme}:{s['resolved_id']}" + text[s["at"] + len(s["target"]) :]
    return text


def feed(changes: DataFrame, grants: list[dict]) -> DataFrame:
    """Changes (seq, op, path, new_path) as a reader sees them: a move over the edge of the view is a create or a delete."""
    live = [g for g in check(grants) if g["state"] == "live"]

    def seen(column: str):
        p, out = F.col(column), None
        for g in live:
            inside = (p == g["root"]) | paths.under(p, g["root"])
            new = F.concat(F.lit(f"/{g['alias']}"), F.substring(p, len(g["root"]) + 1, 1 << 30))
            out = F.when(inside, new) if out is None else out.when(inside, new)
        return F.lit(None).cast("string") if out is None else out

    rows = changes.withColumns({"a": seen("path"), "b": seen("new_path")}).where("a is not null or b is not null")
    moved = F.col("new_path").isNotNull()
    op = F.when(moved & F.col("a").isNull(), "create").when(moved & F.col("b").isNull(), "delete").otherwise(F.col("op"))
    return rows.select("seq", op.alias("op"), F.coalesce("a", "b").alias("path"), F.when(F.col("a").isNotNull(), F.col("b")).alias("new_path"))
