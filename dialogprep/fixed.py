"""Fixed values. They must equal the published ones for results to match."""

# Label value the losses skip, and the reserved id of an image position.
IGNORE_INDEX = -100
IMAGE_TOKEN_INDEX = -200

# Reserved strings.
IMAGE_PLACEHOLDER = "<image>"
IMAGE_PATCH_PLACEHOLDER = "<im_patch>"
IMAGE_START = "<im_start>"
IMAGE_END = "<im_end>"

# Dialogue template.
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"
END_OF_TEXT = "<|endoftext|>"
UNKNOWN = "<|unk|>"
DEFAULT_PROMPT = "Describe this image."

# Normalisation constants per RGB channel.
PIXEL_MEAN = (0.48145466, 0.4578275, 0.40821073)
PIXEL_STD = (0.26862954, 0.26130258, 0.27577711)

# Job defaults.
MAX_LENGTH = 512
BATCH_SIZE = 4
ACCUMULATION = 4
ALPHA = 0.5
TEMPERATURE = 2.0
IMAGE_SIZE = 224

# Ids 0..3 of every vocabulary built here; the pad id is the end-of-text id.
RESERVED_TOKENS = (END_OF_TEXT, TURN_START, TURN_END, UNKNOWN)
PAD_ID = 0
UNKNOWN_ID = 3

# One token is a template marker, a run of letters, a digit, a space or any
# other single character, so joining the tokens gives the text back.
# The commonest kinds come first because the regex engine tries them in turn.
TOKEN_PATTERN = r"\p{L}+|\s|\p{N}|<\|im_start\|>|<\|im_end\|>|[^\s\p{L}\p{N}]"
# Start marker, role name, newline; then end marker, newline.
HEADER_TOKENS = 3
MIN_TURN_TOKENS = 5
