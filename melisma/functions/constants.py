"""Fixed values that results must agree on: weights, word lists, tables and patterns."""

PAIR_WEIGHTS = {"track_tags": 0.55, "genres": 0.25, "artist_tags": 0.15, "release_year": 0.05}
COLLECTION_WEIGHTS = {"best": 0.7, "average": 0.3}
TOP_SEEDS = 5
DUPLICATE_MS = 10_000
YEAR_SPAN = 30
RANK_WEIGHTS = {"retrieval": 0.50, "artist": 0.08, "genre": 0.14, "tag": 0.18, "quality": 0.10}
DIVERSITY_PENALTY = 0.15
FEEDBACK_WEIGHT = 0.15
DIVERSITY_WEIGHTS = {"artist": 0.20, "genres": 0.40, "tags": 0.40}
REWARDS = {"play": 0.1, "play_complete": 0.4, "skip": -0.4, "quick_skip": -0.8, "favorite": 0.8, "like": 0.6, "dislike": -1.0, "playlist_add": 1.0, "replay": 0.5}
FEEDBACK_SIMILARITY = {"artist": 0.25, "genres": 0.35, "tags": 0.40}
FEEDBACK_THRESHOLD = 0.30
COLLECTING_FEEDBACK = ("favorite", "playlist_add")
AGENT_EVENTS = {"liked": "like", "skipped": "skip", "saved": "favorite", "playlist_add": "playlist_add", "request_similar": "like", "hide_artist": "dislike", "hide_track": "dislike"}
AFFINITY_BOOST, AFFINITY_DECAY, AFFINITY_FLOOR, AFFINITY_CAP = 0.34, 0.9, 0.05, 64
VERSION_PRIORITY = {"remastered": 3, "original": 2, "live": 1, "cover": 1, "unknown": 0}
GENRE_TRACK, GENRE_ARTIST = (1.0, 0.05), (0.4, 0.2)
EXTERNAL_PENALTIES = {"family": 0.12, "cluster": 0.06, "signature": 0.20}
VERSION_PENALTIES = {"live_or_session": 0.16, "remastered": 0.06, "deluxe": 0.04, "album_cut": 0.0}
QUALITY_GATE = {"hallucination": 0.5, "grounding": 0.3, "thought": 0.9, "missing": 0}
SPLIT_SEED = 20260615
SPLIT_RATIOS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
MESSAGES_KEPT = 100

GENRE_ALIASES = {
    "alt rock": "alternative_rock", "alternative": "alternative_rock", "alternative rock": "alternative_rock",
    "brit pop": "britpop", "britpop": "britpop", "classic rock": "classic_rock", "dance pop": "dance_pop",
    "dream pop": "dream_pop", "electronic": "electronic", "electronica": "electronic", "folk": "folk",
    "folk rock": "folk_rock", "funk": "funk", "hard rock": "hard_rock", "heavy metal": "metal",
    "hip hop": "hip_hop", "hip-hop": "hip_hop", "indie": "indie", "indie pop": "indie_pop",
    "indie rock": "indie_rock", "jazz": "jazz", "metal": "metal", "new wave": "new_wave", "pop": "pop",
    "pop rock": "pop_rock", "post punk": "post_punk", "post-punk": "post_punk",
    "progressive rock": "progressive_rock", "punk": "punk", "punk rock": "punk", "r&b": "r_and_b",
    "rnb": "r_and_b", "rock": "rock", "shoegaze": "shoegaze", "soul": "soul", "synthpop": "synthpop",
}
NOT_GENRES = ("albums i own", "awesome", "beautiful", "best", "british", "favorites", "favourite", "great", "love", "male vocalists", "manchester", "seen live", "under 2000 listeners")
NOT_PREFERENCES = ("albums i own", "awesome", "beautiful", "best", "favorites", "favourite", "great", "love", "seen live", "wrong track streaming")
DECADE_OR_YEAR = r"^(?:(?:19|20)\d{2}|(?:19|20)?\d0s)$"
RATING = r"^\d+(?:\.\d+)?\s+(?:of|out of)\s+\d+\s+stars?$"
DECADE = r"^(?:19|20)?\d0s$"
VERSION_MARKER = r"\b(?:remaster(?:ed)?|live|mono|stereo|acoustic|demo|edit|mix|version)\b"
REMASTERED = r"\b(?:re-?master(?:ed)?|remaster)\b"
LIVE = r"\b(?:live|concert|unplugged|session|at\s+\w+\s+(?:arena|stadium|hall))\b"
COVER = r"\b(?:cover|tribute|karaoke)\b"
SIGNATURE_MARKERS = ("remaster", "remastered", "deluxe", "radio2session", "session", "live", "edit", "version", "mono", "stereo")
TOOL_NAMES = {
    "L1.inspect_user_profile": "get_user_memory", "L2.inspect_song_profile": "get_track_metadata", "L2.collect_or_import": "get_track_metadata",
    "L2.merge_sources": "get_track_metadata", "L3.retrieve_candidates": "get_similar_tracks", "L4.rank_candidates": "rank_candidates",
    "L5.record_feedback": "record_feedback", "L5.configure_trajectory_sink": "record_feedback",
}
SEEN_REFERENCES = ("刚才推荐过", "刚刚推荐过", "之前推荐过", "上次推荐过", "刚才那些", "刚刚那些", "之前那些", "already recommended", "shown before")
PREFERENCE_ALIASES = {"british rock": "british", "uk rock": "british", "english rock": "british", "britpop": "british", "英伦摇滚": "british"}
DIVERSITY_MARKERS = ("多样", "不同歌手", "不要重复歌手", "每位歌手", "每个歌手", "diverse", "different artists", "per artist")
EXPLICIT_COUNT = r"\d{1,2}\s*(?:首|songs?)|(?:二十|十[一二三四五六七八九]?|[一二两三四五六七八九])\s*首"
