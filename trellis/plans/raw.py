"""Raw JSON side as one lazy plan: landed responses -> complete chains -> items ->
objects with renamed keys -> per-label normalisation -> unified entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis import vocab as V
from trellis.operators import normalize as N
from trellis.operators import unify as U
from trellis.session import stored
from trellis.sources.landed import drop_incomplete_chains, flatten_responses

ORDER = ["request_id", "page_no", "item_no"]
ENDPOINT = "https://wiki.example.org:8443/some/path"


def items_by_label(landed: DataFrame) -> dict[str, DataFrame]:
    # one write of the cleaned items in folders by label, so who reads a label reads no other; what follows from ``doc`` alone is left out
    cleaned = N.clean_items(flatten_responses(drop_incomplete_chains(landed)))
    items = N.with_derived(stored(cleaned.drop("_json", "ext"), "label"))
    labels = ("users", "spaces", "pages", "comments", "teams", "channels", "posts")
    return {lb: items.where(F.col("label") == lb) for lb in labels}


def normalized(landed: DataFrame) -> dict[str, DataFrame]:
    raw = items_by_label(landed)
    spaces = N.normalize_spaces(raw["spaces"])
    pages = N.normalize_pages(raw["pages"], spaces)
    return {
        "users": N.normalize_users(raw["users"]),
        "spaces": spaces,
        "pages": pages,
        "comments": N.normalize_comments(raw["comments"], pages),
        "teams": raw["teams"],
        "channels": N.normalize_channels(raw["channels"], raw["teams"]),
        "posts": N.normalize_posts(raw["posts"]),
    }


def unified(landed: DataFrame, rules=None, sample: str = "first") -> tuple[dict[str, DataFrame], list]:
    frames = normalized(landed)
    return U.unify_all(frames, rules or V.FIELD_RULES, doc="doc", overrides="ext", order_by=ORDER,
                       sample=sample, base_url=U.link_base(ENDPOINT), keep=["label"])
