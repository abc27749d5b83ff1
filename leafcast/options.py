"""Job options (the reference's configuration keys), with their defaults and clamps."""

from __future__ import annotations

from dataclasses import dataclass

from leafcast.functions.dates import resolve_zone

# Defaults of the listing caps and the slim job.
DEFAULT_POSTS_PER_PAGE = 100
DEFAULT_MAX_PAGES = 2
DEFAULT_KEEP_ATTRS = ("colspan", "rowspan", "href", "src", "alt")
DEFAULT_DROP_TAGS = ("script", "style")


@dataclass(frozen=True)
class Options:
    site: str = "https://example.com"
    posts_per_page: int = DEFAULT_POSTS_PER_PAGE
    max_pages_per_type: int = DEFAULT_MAX_PAGES
    timezone: str | None = None
    exclude_type_slugs: tuple[str, ...] = ()
    exclude_type_names: tuple[str, ...] = ()
    exclude_titles: tuple[str, ...] = ()
    exclude_ids: tuple[int, ...] = ()
    show_date: str = "none"
    show_api_endpoint: bool = False
    form_handling: str = "keep"
    keep_attrs: tuple[str, ...] = DEFAULT_KEEP_ATTRS
    drop_tags: tuple[str, ...] = DEFAULT_DROP_TAGS
    unwrap_tags: tuple[str, ...] = ()
    listing_fanout: int = 64

    @property
    def per_page(self) -> int:
        """posts_per_page clamped to 1..100 (the server's cap)."""
        return max(1, min(100, int(self.posts_per_page)))

    @property
    def listing_cap(self) -> int:
        """Posts kept per type: per_page x max_pages_per_type (newest first); page 1 is always read."""
        return self.per_page * max(1, int(self.max_pages_per_type))

    @property
    def zone(self) -> str:
        return resolve_zone(self.timezone)

    @property
    def form_mode(self) -> str:
        return "remove" if self.form_handling == "remove" else "keep"


# Options the adapter-based queries run with (the SQL twins hard-code the same values).
ADAPTER_OPTIONS = Options(
    site="https://example.com",
    timezone="Asia/Tokyo",
    exclude_type_slugs=("/^wp_/", "attachment"),
    exclude_type_names=("/^2-/",),
    exclude_titles=(r"/^Order \d*7 P$/", "Order 42 F"),
    exclude_ids=(7, 44, 1234),
    show_date="date-only",
)
