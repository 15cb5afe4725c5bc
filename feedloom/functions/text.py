"""Text functions: whitespace, emoji, tokens, content keys."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character besides the space that a Unicode-aware split treats as blank.
# The nested class keeps most characters at one range test.
OTHER_BLANK = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
# A blank run that is not already a single space; most text is skipped without a replacement.
BLANK_RUN = rf"(?: [ {OTHER_BLANK}]|[{OTHER_BLANK}])[ {OTHER_BLANK}]*"

# Common emoji and their CLDR short names.
EMOJI_NAMES = {
    "😀": "grinning_face",
    "😃": "grinning_face_with_big_eyes",
    "😄": "grinning_face_with_smiling_eyes",
    "😁": "beaming_face_with_smiling_eyes",
    "😆": "grinning_squinting_face",
    "😅": "grinning_face_with_sweat",
    "🤣": "rolling_on_the_floor_laughing",
    "😂": "face_with_tears_of_joy",
    "🙂": "slightly_smiling_face",
    "🙃": "upside-down_face",
    "😉": "winking_face",
    "😊": "smiling_face_with_smiling_eyes",
    "😇": "smiling_face_with_halo",
    "🥰": "smiling_face_with_hearts",
    "😍": "smiling_face_with_heart-eyes",
    "🤩": "star-struck",
    "😘": "face_blowing_a_kiss",
    "😋": "face_savoring_food",
    "😛": "face_with_tongue",
    "😜": "winking_face_with_tongue",
    "🤪": "zany_face",
    "🤑": "money-mouth_face",
    "🤗": "smiling_face_with_open_hands",
    "🤔": "thinking_face",
    "🤐": "zipper-mouth_face",
    "😐": "neutral_face",
    "😑": "expressionless_face",
    "😶": "face_without_mouth",
    "😏": "smirking_face",
    "😒": "unamused_face",
    "🙄": "face_with_rolling_eyes",
    "😬": "grimacing_face",
    "😌": "relieved_face",
    "😔": "pensive_face",
    "😪": "sleepy_face",
    "😴": "sleeping_face",
    "😷": "face_with_medical_mask",
    "🤢": "nauseated_face",
    "🤮": "face_vomiting",
    "🥵": "hot_face",
    "🥶": "cold_face",
    "😵": "face_with_crossed-out_eyes",
    "🤯": "exploding_head",
    "😎": "smiling_face_with_sunglasses",
    "🤓": "nerd_face",
    "😕": "confused_face",
    "😟": "worried_face",
    "🙁": "slightly_frowning_face",
    "☹": "frowning_face",
    "😮": "face_with_open_mouth",
    "😯": "hushed_face",
    "😲": "astonished_face",
    "😳": "flushed_face",
    "🥺": "pleading_face",
    "😨": "fearful_face",
    "😰": "anxious_face_with_sweat",
    "😢": "crying_face",
    "😭": "loudly_crying_face",
    "😱": "face_screaming_in_fear",
    "😖": "confounded_face",
    "😣": "persevering_face",
    "😞": "disappointed_face",
    "😓": "downcast_face_with_sweat",
    "😩": "weary_face",
    "😫": "tired_face",
    "🥱": "yawning_face",
    "😤": "face_with_steam_from_nose",
    "😡": "enraged_face",
    "😠": "angry_face",
    "🤬": "face_with_symbols_on_mouth",
    "😈": "smiling_face_with_horns",
    "👿": "angry_face_with_horns",
    "💀": "skull",
    "💩": "pile_of_poo",
    "🤡": "clown_face",
    "👻": "ghost",
    "👽": "alien",
    "🤖": "robot",
    "❤": "red_heart",
    "🧡": "orange_heart",
    "💛": "yellow_heart",
    "💚": "green_heart",
    "💙": "blue_heart",
    "💜": "purple_heart",
    "🖤": "black_heart",
    "💔": "broken_heart",
    "💕": "two_hearts",
    "💖": "sparkling_heart",
    "💯": "hundred_points",
    "💥": "collision",
    "💦": "sweat_droplets",
    "👋": "waving_hand",
    "👌": "OK_hand",
    "✌": "victory_hand",
    "🤞": "crossed_fingers",
    "👈": "backhand_index_pointing_left",
    "👉": "backhand_index_pointing_right",
    "👆": "backhand_index_pointing_up",
    "👇": "backhand_index_pointing_down",
    "👍": "thumbs_up",
    "👎": "thumbs_down",
    "✊": "raised_fist",
    "👊": "oncoming_fist",
    "👏": "clapping_hands",
    "🙌": "raising_hands",
    "🙏": "folded_hands",
    "💪": "flexed_biceps",
    "🤷": "person_shrugging",
    "🤦": "person_facepalming",
    "🔥": "fire",
    "⭐": "star",
    "🌟": "glowing_star",
    "✨": "sparkles",
    "⚡": "high_voltage",
    "🎉": "party_popper",
    "🎊": "confetti_ball",
    "🎁": "wrapped_gift",
    "🏆": "trophy",
    "🐛": "bug",
    "💰": "money_bag",
    "💸": "money_with_wings",
    "💳": "credit_card",
    "💲": "heavy_dollar_sign",
    "📱": "mobile_phone",
    "💻": "laptop",
    "🔋": "battery",
    "🔔": "bell",
    "🔕": "bell_with_slash",
    "🔒": "locked",
    "🔓": "unlocked",
    "🔑": "key",
    "📞": "telephone_receiver",
    "📧": "e-mail",
    "⏰": "alarm_clock",
    "⏳": "hourglass_not_done",
    "🐌": "snail",
    "🚀": "rocket",
    "🗑": "wastebasket",
    "✅": "check_mark_button",
    "✔": "check_mark",
    "❌": "cross_mark",
    "❗": "red_exclamation_mark",
    "❓": "red_question_mark",
    "⚠": "warning",
    "🚫": "prohibited",
    "🛑": "stop_sign",
    "🆘": "SOS_button",
    "❤️‍🔥": "heart_on_fire",
    "👩‍💻": "woman_technologist",
    "👨‍💻": "man_technologist",
}
# Skin-tone modifiers.
SKIN_TONES = {
    "🏻": "light_skin_tone",
    "🏼": "medium-light_skin_tone",
    "🏽": "medium_skin_tone",
    "🏾": "medium-dark_skin_tone",
    "🏿": "dark_skin_tone",
}
# Code-point ranges whose remaining members take their Unicode character name.
EMOJI_RANGES = [(0x2600, 0x27BF), (0x1F300, 0x1FAFF)]


def clean_whitespace(text: Column) -> Column:
    """Collapse runs of blank characters to one space and trim."""
    return F.trim(F.regexp_replace(text, BLANK_RUN, " "))


def has_text(text: Column) -> Column:
    """Whether some character is not blank."""
    return text.rlike(rf"[^ {OTHER_BLANK}]")


def emoji_aliases(extra: dict[str, str] | None = None) -> dict[str, str]:
    """emoji -> alias: Unicode names by rule, overlaid with the fixed table and the caller's own."""
    by_rule = {}
    for low, high in EMOJI_RANGES:
        for point in range(low, high + 1):
            char = chr(point)
            if unicodedata.category(char) == "So":
                by_rule[char] = unicodedata.name(char).lower().replace(" ", "_")
    return {**by_rule, **EMOJI_NAMES, **(extra or {})}


def demojize(text: Column, extra: dict[str, str] | None = None) -> Column:
    """Replace each emoji by `` :alias: ``; padded, so neighbours never fuse."""
    names = emoji_aliases(extra)
    # A few wide ranges are cheap to test per character; a member without a name is left as it is.
    outside = {ord(n[0]) for n in names if not any(a <= ord(n[0]) <= b for a, b in EMOJI_RANGES)}
    spans = EMOJI_RANGES + [(point, point) for point in sorted(outside)]
    leads = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans)
    joined = "|".join(sorted((s for s in names if len(s) > 1), key=len, reverse=True))
    tone = r"[\x{1F3FB}-\x{1F3FF}]"
    pattern = rf"(?s)((?:{joined}|[{leads}])\x{{FE0F}}?{tone}?|[^{leads}]+)"
    aliases = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    tones = F.from_json(F.lit(json.dumps(SKIN_TONES)), "map<string,string>")

    def rename(piece: Column) -> Column:
        alias = aliases[F.regexp_replace(piece, rf"\x{{FE0F}}?{tone}?$", "")]
        shade = F.coalesce(F.concat(F.lit("_"), tones[F.regexp_extract(piece, f"({tone})$", 1)]), F.lit(""))
        # A piece without a name stays as it is.
        return F.coalesce(F.concat(F.lit(" :"), alias, shade, F.lit(": ")), piece)

    pieces = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), rename)
    return F.when(text.rlike(f"[{leads}]"), F.array_join(pieces, "")).otherwise(text)


def clean_text(text: Column, extra_emoji: dict[str, str] | None = None) -> Column:
    """Emoji to words, then one space between tokens."""
    return clean_whitespace(demojize(text, extra_emoji))


def tokens(text: Column) -> Column:
    """Lower-case words of the whole text: runs of letters, digits and apostrophes."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}']+"), lambda t: t != "")


def cache_key(prompt_version: Column, text: Column, context_hash: Column | None = None) -> Column:
    """sha256 of ``version:text``, optionally extended by a hash of the retrieval context."""
    parts = [prompt_version, text] + ([context_hash] if context_hash is not None else [])
    glued = parts[0]
    for part in parts[1:]:
        glued = F.concat(glued, F.lit(":"), part)
    return F.sha2(glued, 256)
