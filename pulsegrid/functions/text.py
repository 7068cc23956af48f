"""Text expressions: serial numbers, display names, status keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pulsegrid import fixed


def normalize_serial(serial: Column) -> Column:
    """Maintenance serial to telemetry serial: last seven digits padded to fifteen characters."""
    digits = F.regexp_replace(serial, "[^0-9]", "")
    return F.lpad(F.right(digits, F.lit(7)), 15, "0")


def status_key(name: Column) -> Column:
    """Column suffix of a status name: lower case, blanks to underscores, dots dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), " ", "_"), r"\.", "")


def status_column(name: str) -> str:
    return "bitfield_" + name.lower().replace(" ", "_").replace(".", "")


def human_name(feature: Column) -> Column:
    """Display name of a feature column; unknown names pass through."""
    known = {f"var_{v[0]}": v[1] for v in fixed.VARIABLES} | fixed.DERIVED_FEATURES
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    plain = F.regexp_replace(F.regexp_replace(feature, "bitfield_", ""), "_", " ")
    return F.coalesce(
        F.try_element_at(F.create_map(*pairs), feature),
        F.when(feature.startswith("bitfield_"), plain),
        feature,
    )


def top_features_text(features: list[str], top_n: int = 3) -> str:
    """Names of the first features of the model's list, as shown on an alert."""
    names = {f"var_{v[0]}": v[1] for v in fixed.VARIABLES}
    shown = []
    for feature in features[:top_n]:
        if feature in names:
            shown.append(f"{names[feature]} ({feature})")
        elif feature == "fio2_deviation":
            shown.append(fixed.OXYGEN_DEVIATION_NAME)
        else:
            shown.append(feature)
    return ", ".join(shown)
