"""Which operations a deployment offers: profiles, allow lists and deny lists."""

from __future__ import annotations

# The operations and those that change notes.
OPERATIONS = (
    "vault_list", "vault_info", "note_read", "note_read_many", "note_create", "note_write", "note_insert", "note_patch", "note_delete", "note_move", "search_text", "search_regex",
    "search_metadata", "search_semantic", "note_inspect", "frontmatter", "wikilinks", "periodic", "open_in_obsidian",
)
# The named profiles.
PROFILES = {
    "full": OPERATIONS,
    "core": ("vault_list", "note_read", "note_read_many", "note_create", "note_write", "note_insert", "note_patch", "note_delete", "note_move", "search_text", "search_regex", "search_metadata", "note_inspect", "frontmatter", "vault_info"),
    "read": ("note_read", "note_read_many", "vault_list", "search_text", "search_regex", "search_metadata", "search_semantic", "note_inspect", "wikilinks", "vault_info"),
    "minimal": ("note_read", "note_create", "note_write", "vault_list", "search_text", "vault_info"),
}


def offered(setting: str = "") -> frozenset[str]:
    """Operations that a setting offers: nothing set (all), a profile, names (only those) or, where any has a !, names (all but those).

    Unknown names in a list count for nothing; one unknown name alone is an error.
    """
    names = [x.strip() for x in setting.split(",") if x.strip()]
    if not names:
        return frozenset(OPERATIONS)
    if "!" in setting:
        return frozenset(OPERATIONS) - {x.lstrip("!") for x in names}
    if "," not in setting:
        if names[0].lower() in PROFILES:
            return frozenset(PROFILES[names[0].lower()])
        if names[0] not in OPERATIONS:
            raise ValueError(f"neither a profile nor an operation: {names[0]!r}")
    return frozenset(OPERATIONS) & set(names)
