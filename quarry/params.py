"""Parameters.

The first block holds fixed values that must equal the reference job's
defaults for results to agree; everything below it is this engine's own.
"""

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's defaults)
# ---------------------------------------------------------------------------
MASK_ID = -100                      # label position that carries no loss
RAGGED_PAD_ID = -1                  # dense padding in imported caches
NUM_NEIGHBORS = 10                  # neighbours cached per question
NUM_RETRIEVALS = 5                  # contexts sampled per question
TEMPERATURE = 0.03                  # sampling temperature over scores
CONTEXT_SIZE = 1024                 # model context, also field truncation
MAX_GENERATION_LENGTH = 350         # reserved answer length in the budget
NUM_SHARDS = 2048                   # cache shards per split
BATCHES_BETWEEN_EVALS = 5           # schedule: train batches per round
NUMBER_EVAL_BATCHES = 1             # schedule: eval batches per round
EMA_CONSTANT = 0.9                  # moving-average constant for losses
SPLIT_CARDINALITIES = {"train": 272637, "eval": 1507, "test": 600}
HELPER_MODES = ("multiple", "once")
SPLITS = ("train", "eval", "test")
QA_LENGTH_FRACTIONS = (.55, .6, .65, .7, .75, .775, .8, .825, .85, .875, .9, .925, .95, .975)
PASSAGE_LENGTH_FRACTIONS = (.8, .85, .875, .9, .925, .95, .975)
MAX_NUM_RETRIEVALS_STUDY = 4        # budget table: (ctx - cutoff) / i, i = 1..4
PASSAGE_LENGTH_SAMPLE = 10000       # passages sampled for the length study
IVF_NUM_LEAVES = 1000
IVF_LEAVES_TO_SEARCH = 100
IVF_TRAINING_SAMPLE = 100000
IVF_REORDER = 100
PQ_DIMS_PER_BLOCK = 2
SAVE_PERIOD_MIN = 20                # checkpoint cadence, minutes
# ---------------------------------------------------------------------------

# Engine parameters (not from the reference)
SEED = 7                            # default sampling seed
MAX_BROADCAST_BYTES = 256 << 20     # bound for broadcasting data-dependent tables (hits, candidates, maps)
TOKEN_PATTERN = r"[^ \t\n\r\f\x0B]+"   # whitespace split, identical in Java regex and RE2

# White space, and the characters that are tokens of their own (ASCII punctuation and symbols, Unicode
# punctuation, CJK ideographs), as regular-expression classes of Java and RE2.
DELIMITER_SPACE = r"\t\n\f\r "
DELIMITER_PUNCTUATION = r"!-/:-@\[-`{-~\p{P}"
DELIMITER_CJK = (r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
                 r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}")
DELIMITER_PATTERN = (f"[{DELIMITER_PUNCTUATION}{DELIMITER_CJK}]"
                     f"|[^{DELIMITER_SPACE}{DELIMITER_PUNCTUATION}{DELIMITER_CJK}]+")


# Reserved ids come first, so that they don't depend on how many tokens a vocabulary has.
SPECIALS = ("oov", "eos", "cls", "sep", "question", "context", "answer")
FIRST_TOKEN_ID = len(SPECIALS)


def special_ids() -> dict:
    """Reserved ids below the vocabulary's: OOV, eos, cls, sep and one id per helper word."""
    return {name: i for i, name in enumerate(SPECIALS)}
