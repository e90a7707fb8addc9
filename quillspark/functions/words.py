"""Word and phrase lists.

Fixed values: results depend on exactly these words.
"""

LOCAL_IGNORE_WORDS = ["vooks", "vo0ks", "vook", "vooksy", "wooks", "storybooks", "storybook", "tm"]

LOCAL_REJECT_PHRASES = [
    "app store", "app for free", "ask your grown up", "brought to life", "continue watching", "for more stories",
    "google play", "new releases", "popular titles", "subscribe", "thanks for watching", "thank you for watching",
    "try the app", "created by", "written by", "illustrated by", "copyright", "all rights reserved", "age elementary",
    "available from", "based on the storybook", "cover design", "designed by", "edited by", "published in",
    "published by", "start exploring more fun stories", "watch now", "you'll be glad you did",
]

FUSED_TOKENS = {
    "bearpoo": ["bear", "poo"],
    "doesa": ["does", "a"],
    "eightall": ["eight", "all"],
    "firefliesgotcha": ["fireflies", "gotcha"],
    "ihear": ["i", "hear"],
    "inthe": ["in", "the"],
    "it'sa": ["it's", "a"],
    "moonsnail": ["moon", "snail"],
    "musselshell": ["mussel", "shell"],
    "seashe": ["seashell"],
    "seashel": ["seashell"],
    "seashelt": ["seashell"],
    "tenboth": ["ten", "both"],
    "whelkshell": ["whelk", "shell"],
}

LOCAL_SHORT_WORDS = "a am an as at be by do go he hi i if in is it me my no of on or poo she the to up we who you".split()

LEGACY_IGNORE_WORDS = ["vooks", "vo0ks", "vook", "vooksy", "wooks", "storybooks", "storybook", "brought", "life", "tm", "vie", "vcc"]

TITLE_IGNORE_WORDS = "a an and animated book books for full in kids narrated of official read story storybook storybooks stories the to vooks with".split()

FRAME_REJECT_PHRASES = [
    "app store", "google play", "download on the", "get it on", "try the app", "free today", "thank you for watching",
    "thank you for watch", "thank you for watc", "thank you for wat", "thanks for watching", "created by", "credits",
    "www", "com", "available on", "narrated storybooks", "storybooks brought", "brought to life", "brought to lif",
    "bscribe", "scribe", "ubscribe", "like subscribe", "thank you for", "executive producer", "executive producers",
    "music by", "voice talent", "sound design", "registered trademark", "copyright", "all rights reserved",
    "unicorn and horse",
]

TITLE_REJECT_PHRASES = ["illustrated by", "tllustrated", "tlustrated", "lustrated by", "written by", "by by", "anna kang", "christopher weyant", "created by vooks"]

AD_ITEM_WORDS = "subscribe subscribed ubscribe bscribe scribe app store google play download watching".split()

USEFUL_SHORT_WORDS = "a i am an and are fun hot no not now or of pan pit the tub to is we yes you".split()

ALLOWED_SHORT_TOKENS = "a i am an as at be by do go he hi if in is it me my no of oh ok on or so to um up us we".split()

TRAILING_FRAGMENT_TOKENS = "a an and as at but for if in of on or so that the to when where which who with".split()

OCR_GLITCH_WORDS = "arenot ay earen erie frends gore i'mbl imbl kr nl si wn".split()

WATERMARK_MARKERS = ["vooks", "vo0ks", "wooks", "gvooks"]

NON_STORY_LABELS = ["music", "applause", "laughter", "foreign"]
