"""Ranks, genre graph, theme clusters, bands and word lists.

Large maps (raw genre to canonical genre) are parameters: a DataFrame the
caller supplies.
"""

from __future__ import annotations

FORMAT_RANK = {".flac": 6, ".wav": 5, ".aiff": 4, ".aif": 4, ".m4a": 3, ".ogg": 2, ".opus": 2, ".mp3": 1, ".wma": 0}

TAXONOMY = (
    "Deathrock", "Gothic Rock", "Darkwave", "Coldwave", "Post-Punk", "EBM", "Industrial", "New Wave", "Synthpop", "Ambient", "IDM", "Electronic",
    "Alternative Rock", "Indie Rock", "Punk", "Metal", "Hard Rock", "Classic Rock", "Rock", "Folk", "Pop", "Hip-Hop", "Soundtrack", "Comedy", "Other",
)

NEIGHBOURS = {
    "Gothic Rock": ("Post-Punk", "Darkwave", "New Wave", "Alternative Rock", "Death Rock"),
    "Darkwave": ("Gothic Rock", "Post-Punk", "Synthpop", "EBM", "Ambient", "Coldwave"),
    "Post-Punk": ("Gothic Rock", "Darkwave", "New Wave", "Alternative Rock", "Punk"),
    "EBM": ("Industrial", "Synthpop", "Electronic", "Darkwave"),
    "Industrial": ("EBM", "Electronic", "Metal", "Hard Rock", "Noise"),
    "New Wave": ("Synthpop", "Post-Punk", "Gothic Rock"),
    "Synthpop": ("New Wave", "EBM", "Darkwave", "Electronic"),
    "Electronic": ("EBM", "Industrial", "Ambient", "Synthpop"),
    "Ambient": ("Electronic", "Darkwave", "Soundtrack"),
    "Rock": ("Alternative Rock", "Hard Rock", "Punk"),
    "Alternative Rock": ("Rock", "Indie Rock", "Post-Punk", "Punk"),
    "Indie Rock": ("Alternative Rock", "Rock", "Post-Punk"),
    "Hard Rock": ("Rock", "Metal", "Punk"),
    "Punk": ("Post-Punk", "Alternative Rock", "Hard Rock"),
    "Metal": ("Hard Rock", "Industrial", "Punk"),
    "Shoegaze": ("Darkwave", "Post-Punk", "Gothic Rock", "Ambient"),
    "Coldwave": ("Darkwave", "Post-Punk", "EBM"),
    "Neofolk": ("Ambient", "Gothic Rock", "Darkwave"),
    "Death Rock": ("Gothic Rock", "Punk", "Post-Punk"),
    "Noise": ("Industrial", "Electronic"),
    "Witch House": ("Darkwave", "Electronic", "Ambient"),
    "Soundtrack": ("Ambient", "Electronic"),
    "Classical": ("Ambient", "Soundtrack"),
    "Folk": ("Indie Rock", "Alternative Rock"),
    "Pop": (),
    "Hip-Hop": (),
    "Comedy": (),
    "Other": (),
}

CORE_GENRES = (
    "Gothic Rock", "Darkwave", "Post-Punk", "EBM", "Industrial", "New Wave", "Synthpop", "Electronic", "Ambient", "Alternative Rock", "Punk", "Hard Rock",
    "Metal", "Indie Rock", "Rock", "Noise", "Shoegaze", "Coldwave", "Neofolk", "Death Rock", "Goth", "Witch House", "Minimal Wave", "Power Electronics",
)
SHOW_GENRES = (
    "Gothic Rock", "Darkwave", "Post-Punk", "EBM", "Industrial", "New Wave", "Synthpop", "Electronic", "Ambient", "Shoegaze", "Coldwave", "Neofolk",
    "Death Rock", "Goth", "Witch House", "Minimal Wave", "Power Electronics", "Noise",
)
FLOOR_GENRES = (
    "EBM", "Industrial", "Gothic Rock", "Darkwave", "Post-Punk", "Synthpop", "Electronic", "New Wave", "Hard Rock", "Metal", "Alternative Rock", "Punk",
    "Dark Electro", "Aggrotech", "Noise", "Power Electronics", "Futurepop",
)

THEME_CLUSTERS = (
    ("loss", "isolation", "nostalgia", "alienation"),
    ("love", "loss", "longing"),
    ("anger", "rebellion", "power"),
    ("darkness", "death", "spirituality"),
    ("euphoria", "love"),
    ("identity", "alienation", "isolation"),
)

STAR_RANKING = {0: 0, 1: 51, 2: 102, 3: 153, 4: 204, 5: 255}
SMALL_WORDS = ("a", "an", "the", "and", "but", "or", "for", "nor", "as", "at", "by", "in", "of", "on", "to", "up", "via", "vs", "vs.", "feat", "ft")
TITLE_GENRES = ("ebm", "goth", "industrial", "darkwave", "synth", "synthpop", "punk", "metal", "rock", "pop", "rave", "techno", "trance", "house", "electronic", "alternative", "new wave", "post-punk", "cold wave", "noise")
GENRE_WORDS = (
    "80s", "70s", "60s", "90s", "00s", "rock", "pop", "goth", "metal", "punk", "industrial", "electronic", "edm", "techno", "house", "trance", "jazz", "blues",
    "classical", "country", "hip hop", "hiphop", "rap", "r&b", "rnb", "alternative", "indie", "folk", "reggae", "soul", "funk", "disco", "ambient", "darkwave",
    "ebm", "noise", "drone", "psytrance", "psy", "vaporwave",
)


def two_steps() -> list[tuple[str, str, float]]:
    """All ordered genre pairs with a compatibility of their own: 0.6 one step away, 0.3 two."""
    pairs: dict[tuple[str, str], float] = {}
    for a, near in NEIGHBOURS.items():
        for b in near:
            for c in NEIGHBOURS.get(b, ()):
                pairs.setdefault((a, c), 0.3)
    for a, near in NEIGHBOURS.items():
        for b in near:
            pairs[(a, b)] = 0.6
    return sorted((a, b, w) for (a, b), w in pairs.items() if a != b)


def theme_pairs() -> list[tuple[str, str, float]]:
    """All ordered pairs of different themes: 1.0 in one cluster, 0.5 in overlapping ones."""
    themes = sorted({t for c in THEME_CLUSTERS for t in c})
    out = []
    for a in themes:
        for b in themes:
            if a == b:
                continue
            mine, theirs = [set(c) for c in THEME_CLUSTERS if a in c], [set(c) for c in THEME_CLUSTERS if b in c]
            if any(b in c for c in mine):
                out.append((a, b, 1.0))
            elif any(x & y for x in mine for y in theirs):
                out.append((a, b, 0.5))
    return out


# Artists whose names and titles are written in lower case.
LOWERCASE_NAMES = ("of Montreal", "múm", "mind.in.a.box")
