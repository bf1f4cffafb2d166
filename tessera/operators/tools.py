"""Tool plug-ins: a schema and a callable with its settings bound, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import convert


class Tools:
    """A tool takes a call's arguments and the image's path and size as Columns, and gives a Column."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[dict, Callable[..., Column]]] = {}

    def register(self, name: str, schema: dict, call: Callable[..., Column], **settings: object) -> None:
        if name in self._known:
            raise ValueError(f"tool {name!r} is registered twice")
        self._known[name] = schema, partial(call, **settings)

    def schema(self, name: str) -> dict:
        return self._known[name][0]

    def call(self, name: Column, arguments: Column, path: Column, width: Column, height: Column) -> Column:
        """The result of the named tool; NULL for a name that is not registered."""
        out = F.lit(None)
        for known, (_, tool) in self._known.items():
            out = F.when(name == known, tool(arguments, path, width, height)).otherwise(out)
        return out


def zoom_in(arguments: Column, path: Column, width: Column, height: Column, padding: float = 0.1, threshold: float | None = None) -> Column:
    """path#x1,y1,x2,y2 of the crop; NULL where it is too small."""
    b = arguments["bbox_2d"]
    box = G.box(b[0], b[1], b[2], b[3])
    cut = G.zoom_box(box, F.struct(F.lit(padding).alias("x"), F.lit(padding).alias("y")), width, height, width, height, threshold)
    return F.when(cut.isNotNull(), F.concat(path, F.lit("#"), F.concat_ws(",", *(cut[c].cast("string") for c in ("x1", "y1", "x2", "y2")))))


def show_image(arguments: Column, path: Column, width: Column, height: Column) -> Column:
    return path


def default_tools(padding: float = 0.1) -> Tools:
    out = Tools()
    out.register("zoom_in", convert.ZOOM_SCHEMA, zoom_in, padding=padding)
    out.register("show_image", convert.customize(convert.ZOOM_SCHEMA, {"function,name": "show_image"}), show_image)
    return out
