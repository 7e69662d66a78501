"""Fixed values.

Values below must equal the behaviour being reproduced; they are stated
plainly and in natural order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES -- model defaults
# ---------------------------------------------------------------------------
MIN_RATING = 1.0
MAX_RATING = 5.0
N_COMPONENTS = 64
MIN_ALPHA = 0.2
ALPHA_E_FOLD = 12.0            # called "half life" upstream, used as exp(-n / 12)
PRIOR_WEIGHT = 0.1
CF_CANDIDATES = 800
CONTENT_CANDIDATES = 800
PRIOR_CANDIDATES = 400
CANDIDATE_FLOOR = 50
RECENCY_E_FOLD = 6.0
MAX_FEATURES = 80_000
MIN_DF = 2
CONTENT_REASON_THRESHOLD = 0.18
CF_REASON_THRESHOLD = 4.0
RELEVANCE_THRESHOLD = 4.0
MIN_USER_REVIEWS = 3
MIN_ITEM_REVIEWS = 5
MIN_BUSINESS_REVIEWS = 10
N_NEGATIVES = 100
SEED = 42
ACTIVE_WINDOW_MINUTES = 20
MAX_EVENT_HISTORY = 5000
MAX_USER_EVENTS = 200

# Popularity prior weights: log1p(review_count), stars, log1p(tips), log1p(check-ins)
PRIOR_W_REVIEWS = 0.35
PRIOR_W_STARS = 0.25
PRIOR_W_TIPS = 0.20
PRIOR_W_CHECKINS = 0.20
# Popularity fallback: prior and stars / 5
FALLBACK_W_PRIOR = 0.7
FALLBACK_W_STARS = 0.3

# Activity levels: < 5 low, < 25 medium, else high
LEVEL_LOW_BELOW = 5
LEVEL_MEDIUM_BELOW = 25

# ---------------------------------------------------------------------------
# FIXED VALUES -- region allow-list (50 states + DC)
# ---------------------------------------------------------------------------
US_STATE_CODES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA",
    "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD",
    "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC",
    "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
    "DC",
)

# ---------------------------------------------------------------------------
# FIXED VALUES -- weekday names, Monday first
# ---------------------------------------------------------------------------
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# ---------------------------------------------------------------------------
# FIXED VALUES -- explanation texts
# ---------------------------------------------------------------------------
TEXT_COLD_START = ("No history available, so ranking leans on popularity priors "
                   "and global collaborative signal.")
TEXT_CATEGORY = "Category match with frequent interests: %s."
TEXT_CONTENT = "Content similarity is strong (%.3f) against the user's past businesses."
TEXT_CF = "Collaborative branch predicts a high rating (%.2f/5)."
TEXT_ALPHA = "Hybrid blend uses alpha=%.3f, adapting to %s activity."
TEXT_DEFAULT = "Business remains competitive after blending content, collaborative, and prior signals."
TEXT_SUMMARY_EMPTY = "No interaction history yet. The system treats this user as cold-start."
TEXT_SUMMARY = ("User has %s activity with %d interactions, average given stars %.2f, "
                "and most often engages with %s.")
TEXT_MIXED = "mixed categories"

# ---------------------------------------------------------------------------
# FIXED VALUES -- token pattern and English stop words
# Tokens are runs of two or more letters, digits or underscores.  The stop
# word list is Spark ML's default English list (181 entries), in its order.
# ---------------------------------------------------------------------------
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
TOKEN_PATTERN_RE2 = r"[\pL\pN_]{2,}"

STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll "
    "they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
    "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't "
    "wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's "
    "there's what's when's where's who's why's would"
).split()


# FIXED VALUES: columns of a profile that an account row decides, and the aliases that account rows carry.
ACCOUNT_COLUMNS = (
    "name", "yelping_since", "review_count_profile", "average_stars_profile", "fans", "useful_votes", "funny_votes", "cool_votes",
    "elite_year_count", "friends_count", "compliment_hot", "compliment_more", "compliment_profile", "compliment_cute", "compliment_list",
    "compliment_note", "compliment_plain", "compliment_cool", "compliment_funny", "compliment_writer", "compliment_photos",
)
ACCOUNT_ALIASES = {"review_count_profile": "review_count", "average_stars_profile": "average_stars", "useful_votes": "useful",
                   "funny_votes": "funny", "cool_votes": "cool"}
