"""Names, tables and texts that results must agree on."""

# Model settings.
MODELS = {
    "flux": {
        "model_id": "stabilityai/stable-diffusion-xl-base-1.0",
        "keep_loaded": True,
        "idle_timeout": None,
        "default_steps": 30,
        "default_size": (1024, 1024),
        "guidance_scale": 7.5,
    },
    "sdxl": {
        "model_id": "stabilityai/stable-diffusion-xl-base-1.0",
        "keep_loaded": False,
        "idle_timeout": 300,
        "default_steps": 30,
        "default_size": (1024, 1024),
        "guidance_scale": 7.5,
    },
    "controlnet": {
        "model_id": "xinsir/controlnet-union-sdxl-1.0",
        "keep_loaded": False,
        "idle_timeout": 180,
        "default_steps": 30,
        "default_size": None,
        "guidance_scale": 7.5,
    },
    "brushnet": {
        "model_id": "TencentARC/BrushNet",
        "keep_loaded": False,
        "idle_timeout": 180,
        "default_steps": 30,
        "default_size": None,
        "guidance_scale": 7.5,
    },
}
ACCEPTED_MODELS = ("flux",)
DEFAULT_GUIDANCE = 7.5

# Order of the components in the progress display.
COMPONENT_ORDER = ("input", "api", "loading", "encoding", "diffusion", "saving", "complete")

# Display stage of a timed component, and the stages in display order.
STAGE_OF_COMPONENT = {
    "input": "stageInput",
    "text-encode": "stageEncoding",
    "text-embed": "stageEncoding",
    "image-encode": "stageEncoding",
    "diffusion": "stageProcessing",
    "vae-decode": "stageDecoding",
    "output": "stageOutput",
}
DISPLAY_STAGES = ("stageInput", "stageEncoding", "stageProcessing", "stageDecoding", "stageOutput")

# Modes in which a component takes part.
COMPONENT_MODES = {
    "input": "all",
    "api": "all",
    "text-encode": "text2img,text2audio,text2video,llm,controlnet",
    "text-embed": "text2img,text2audio,text2video,controlnet",
    "image-encode": "img2img,img2video,controlnet",
    "vae-encode": "img2img,img2video",
    "audio-encode": "audio2text",
    "audio-features": "audio2text",
    "diffusion": "text2img,img2img,text2video,img2video,controlnet",
    "llm-inference": "llm",
    "tts-synthesis": "text2audio",
    "asr-model": "audio2text",
    "vae-decode": "text2img,img2img,text2video,img2video,controlnet",
    "vocoder": "text2audio",
    "text-decode": "llm,audio2text",
    "output": "all",
}

# Mode texts.
DEFAULT_MODE = "text2img"
IMAGE_MODES = ("img2img", "controlnet")
NO_IMAGE_NOTE = "WARNING: No reference image provided, falling back to text2img"
IMAGE_NOTE = "Reference image received (base64 encoded)"

# Step ranges of the thermal guide (name, first, last).
PHASES = (("normal", 5, 60), ("throttled", 65, 75), ("recovered", 80, None))

# Step plans of the sweep runs.
PROGRESSIVE_STEPS = tuple(range(5, 51, 5))
LONG_STEPS = tuple(range(5, 101, 5))
QUALITY_STEPS = (10, 20, 30)

# White space as a text strip or split sees it, as ranges of code points.
SPACE_RANGES = (
    (0x09, 0x0D),
    (0x1C, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)
# The same as a set of characters, and as the body of a character class (Java and RE2).
SPACE_CHARS = "".join(chr(c) for first, last in SPACE_RANGES for c in range(first, last + 1))
SPACE = "".join(f"\\x{{{first:x}}}-\\x{{{last:x}}}" for first, last in SPACE_RANGES)

# What a rejected or odd request is told.
MODEL_REJECTED = "Model not available: "
PROMPT_REJECTED = "Prompt cannot be empty"
SIZE_WARNING = "Height and width should be multiples of 8"

# Descriptions of the modes; a strength goes between the two parts of the second.
TEXT_DESCRIPTION = "Text-to-Image (generate from scratch)"
IMAGE_DESCRIPTION = ("Image-to-Image (transform existing image, strength=", ")")
CONTROL_DESCRIPTION = "ControlNet (structure-guided generation)"

# The two functions that may be called, and what other calls are told.
IMAGE_FUNCTION = "generate_image"
BATCH_FUNCTION = "generate_images_batch"
FUNCTION_UNKNOWN = "Unknown function: "
ARGUMENT_MISSING = "Missing required argument: "

# What a result says.
IMAGE_MADE = "Image generated successfully"
BATCH_MADE = ("Generated ", " images successfully")
