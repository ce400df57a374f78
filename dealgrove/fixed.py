"""Fixed values.

Everything here has to equal the published rules for results to agree: word
lists, score tables, size labels and enumerations. Nothing is computed.
"""

from __future__ import annotations

SPORTS = [
    "soccer", "basketball", "hockey", "lacrosse", "tennis",
    "baseball", "softball", "running", "football", "multi",
]
CATEGORIES = ["footwear", "apparel", "protective", "equipment", "bags", "accessories"]
CURRENCIES = ["USD"]
SIZE_TYPES = ["youth", "junior", "adult", "unknown"]
SESSION_STATUSES = ["running", "completed", "failed", "cancelled"]

# Brand prestige, 0-10.
BRAND_SCORES = {
    "NIKE": 8.5,
    "ADIDAS": 8.0,
    "UNDER ARMOUR": 7.5,
    "PUMA": 7.0,
    "NEW BALANCE": 7.0,
    "ASICS": 6.5,
    "MIZUNO": 6.5,
    "WILSON": 6.5,
    "HEAD": 6.5,
    "BABOLAT": 6.5,
    "BAUER": 8.0,
    "CCM": 7.5,
    "WARRIOR": 7.0,
    "SHER-WOOD": 6.5,
    "EASTON": 7.0,
    "RAWLINGS": 7.0,
    "LOUISVILLE": 6.5,
    "MOLTEN": 6.0,
    "SPALDING": 6.0,
    "UMBRO": 6.5,
    "KAPPA": 6.0,
    "DIADORA": 6.0,
    "BROOKS": 7.5,
    "SAUCONY": 7.0,
    "HOKA": 7.5,
    "ON": 7.0,
    "ALTRA": 6.5,
    "CHAMPION": 5.0,
    "RUSSELL": 4.5,
    "STARTER": 4.0,
    "FRUIT OF THE LOOM": 3.5,
}
DEFAULT_BRAND_SCORE = 5.0

# Extra points for a brand within one sport.
SPORT_BRAND_BONUSES = {
    "hockey": {"BAUER": 2.0, "CCM": 1.5, "WARRIOR": 1.0, "SHER-WOOD": 0.5},
    "baseball": {"EASTON": 1.5, "RAWLINGS": 1.5, "WILSON": 1.0, "LOUISVILLE": 1.0},
    "soccer": {"ADIDAS": 1.0, "NIKE": 1.0, "PUMA": 0.5, "UMBRO": 0.5},
    "tennis": {"WILSON": 1.5, "HEAD": 1.5, "BABOLAT": 1.5, "YONEX": 1.0},
    "running": {"BROOKS": 1.5, "SAUCONY": 1.0, "HOKA": 1.5, "ASICS": 1.0},
}

# Entities decoded after whitespace clean-up, in this order.
HTML_ENTITIES = [
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&nbsp;", " "),
]

# Words that can never be a brand on their own.
NON_BRAND_WORDS = ["the", "new", "best", "top", "pro", "elite"]

# Audience words of the generic detector.
YOUTH_WORDS = [
    "youth", "jr", "junior", "kids", "kid", "boy", "boys", "girl", "girls",
    "child", "children", "toddler", "infant", "baby", "little", "small",
    "ys", "ym", "yl", "yxl", "yxxl",
]
ADULT_WORDS = [
    "adult", "men", "mens", "women", "womens", "man", "woman",
    "grown", "mature", "senior",
]

# Audience words of the per-source rule; one source lacks "infant".
SOURCE_YOUTH_WORDS = [
    "youth", "jr", "junior", "kids", "boy", "girl", "child",
    "ys", "ym", "yl", "yxl", "yxxl",
    "little", "small", "toddler", "infant",
]
SOURCE_ADULT_WORDS = ["adult", "men", "mens", "women", "womens", "man", "woman"]

# Audience words of the youth score.
SCORE_YOUTH_SIZE_TOKENS = ["Y", "JR", "JUNIOR", "KIDS", "BOY", "GIRL"]
SCORE_YOUTH_WORDS = ["youth", "jr", "junior", "kids", "boy", "girl", "child"]
SCORE_ADULT_WORDS = ["adult", "men", "mens", "women", "womens"]

# Size tokens that mark a youth-sized product.
YOUTH_SIZE_TOKENS = [
    "Y", "YS", "YM", "YL", "YXL", "YXXL",
    "JR", "JUNIOR", "KIDS", "KID", "BOY", "BOYS", "GIRL", "GIRLS",
]

# Size labels with a canonical spelling other than their own.
SIZE_ALIASES = {"JUNIOR": "JR", "KID": "KIDS", "BOYS": "BOY", "GIRLS": "GIRL"}

SIZE_PLACEHOLDERS = ["Select Size", "Size", "Choose Size"]

# Regular expressions (group 1 is the value).
PRICE_SYMBOLS = r"[$£€¥]"
PRICE_LABELS = r"(?:price|cost|was|now|sale):\s*"
PRICE_NUMBER = r"(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)"
BRAND_PATTERNS = [
    r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)",
    r"([A-Z][A-Z]+)",
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+",
]
# Words and numbers. Words such as Y..., JR, KIDS or BOY are among the words that the first half finds,
# and no word overlaps a number, so one pass finds what a pattern for each of them would.
SIZE_PATTERN = r"\b([A-Z]+\d*|\d+(?:\.\d+)?)\b"
SIZE_RANGE_PATTERN = r"\b(\d+-\d+)\b"
COUPON_PATTERNS = [
    r"(?:code|coupon)[:\s]*([A-Z0-9]{3,20})",
    r"([A-Z0-9]{3,20})(?:\s+off|\s+discount)",
    r"save\s+([A-Z0-9]{3,20})",
    r"use\s+code\s+([A-Z0-9]{3,20})",
]
PROMOTION_END_PATTERNS = [
    r"ends?\s+(?:on\s+)?(\w+\s+\d{1,2}(?:st|nd|rd|th)?)",
    r"expires?\s+(?:on\s+)?(\w+\s+\d{1,2}(?:st|nd|rd|th)?)",
    r"valid\s+until\s+(\w+\s+\d{1,2}(?:st|nd|rd|th)?)",
    r"through\s+(\w+\s+\d{1,2}(?:st|nd|rd|th)?)",
]
SKU_LABEL = r"^(sku|item|product)[:\s]*"
PART_NUMBER = r"^[A-Za-z0-9\-_.]+$"

# Category keywords, first matching group wins, else "accessories".
CATEGORY_DEFAULT = "accessories"
CATEGORY_KEYWORDS = [
    ("footwear", ["shoe", "cleat", "sneaker", "boot", "footwear"]),
    ("apparel", ["shirt", "jersey", "pant", "short", "jacket", "apparel", "clothing"]),
    ("protective", ["helmet", "pad", "guard", "protection", "safety"]),
    ("equipment", ["ball", "bat", "stick", "racket", "club", "equipment"]),
    ("bags", ["bag", "backpack", "duffel", "luggage"]),
]
# The one source with its own shorter lists.
DICKS_CATEGORY_KEYWORDS = [
    ("footwear", ["shoe", "cleat", "sneaker", "boot"]),
    ("apparel", ["shirt", "jersey", "pant", "short", "jacket", "hoodie"]),
    ("protective", ["helmet", "pad", "guard", "protection"]),
    ("equipment", ["ball", "bat", "stick", "racket", "club"]),
    ("bags", ["bag", "backpack", "duffel"]),
]
# Extra keywords by source.
SOCCER_EXTRA_KEYWORDS = {"protective": ["shin"]}
MONKEY_EXTRA_KEYWORDS = {"footwear": ["skate"], "protective": ["glove"], "equipment": ["puck"]}

# Sport keywords, first matching group wins, else "multi".
SPORT_DEFAULT = "multi"
SPORT_KEYWORDS = [
    ("soccer", ["soccer", "football"]),
    ("basketball", ["basketball", "hoop"]),
    ("hockey", ["hockey", "ice"]),
    ("lacrosse", ["lacrosse", "lax"]),
    ("tennis", ["tennis", "racquet"]),
    ("baseball", ["baseball", "softball"]),
    ("running", ["running", "jog", "athletic"]),
    ("football", ["football", "gridiron"]),
]
# Sport by store name for the stores that sell one sport.
STORE_NAME_SPORTS = ["hockey", "baseball", "lacrosse"]


# What stores call the parts of a product card on their own pages.
STORE_SELECTORS = {
    "default": {
        "sku": [".product-sku", ".sku"],
        "breadcrumb": [".breadcrumb", ".category-path", ".product-category"],
        "sizes": [".size-selector", ".size-options", ".size-grid"],
        "size_item": ["a", "button", ".size-option"],
        "stock": [".stock-status", ".availability", ".inventory"],
        "promo": [".sale-badge", ".clearance-badge", ".promo-badge", ".deal-tag"],
        "coupon": [".coupon-code", ".promo-code", ".discount-code"],
        "age": [".age-range", ".recommended-age", ".age-group"],
    },
    "academy": {
        "brand_specific": [".brand-name", ".product-brand", ".manufacturer"],
        "breadcrumb": [".breadcrumb", ".nav-breadcrumb", ".category-path"],
        "sizes": [".size-selector", ".size-options", ".available-sizes"],
        "stock": [".stock-status", ".availability", ".inventory-status"],
        "promo": [".sale-badge", ".clearance-badge", ".promo-badge", ".deal-badge"],
        "coupon": [".coupon-info", ".promo-code", ".discount-code"],
        "age": [".age-range", ".recommended-age"],
    },
    "big5": {
        "brand_specific": [".brand-name", ".product-brand", ".manufacturer"],
        "sizes": [".size-selector", ".size-options", ".size-list"],
        "stock": [".stock-status", ".availability", ".inventory-status"],
    },
    "dicks": {
        "sku": ["[data-testid=product-sku]", ".product-sku", ".sku"],
        "brand_specific": [".brand-link", ".product-brand", "[data-testid=product-brand]"],
        "breadcrumb": [".breadcrumb", ".category-path"],
        "sizes": [".size-selector", ".available-sizes"],
        "size_item": ["a", "button"],
        "stock": [".stock-status", ".availability"],
        "promo": [".promo-badge", ".sale-badge", ".clearance-badge"],
        "coupon": [".coupon-code", ".promo-code"],
    },
    "monkey": {"brand_specific": [".brand-name", ".product-brand", ".manufacturer"]},
    "scheels": {
        "brand_specific": [".brand-name", ".product-brand", ".manufacturer-name"],
        "breadcrumb": [".breadcrumb", ".category-navigation", ".product-category"],
        "size_item": ["a", "button", ".size-item"],
    },
    "soccer": {"brand_specific": [".brand-name", ".product-brand", ".manufacturer"]},
}
