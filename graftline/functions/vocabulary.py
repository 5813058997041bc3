"""Fixed values of the label space, as published with the data sets they describe."""

TRANSMITTERS = ("acetylcholine", "glutamate", "gaba", "dopamine", "serotonin", "octopamine", "histamine")
OUT_OF_SCOPE = ("tyramine", "glycine")
IGNORED = (
    "snpf", "dnpf", "npf", "tachykinin", "mip", "dh44", "dh31", "dh", "itp", "nitric oxide", "no", "proctolin",
    "allatostatin", "allatostatin-a", "allatostatin-c", "corazonin", "hugin", "leucokinin", "sifamide", "myosuppressin",
    "myosupressin", "fmrfamide", "fmrfa", "pdf", "ilp2", "dilp3", "nplp1", "cnma", "drosulfakinin", "eclosion hormone",
    "capability", "space blanket", "unknown", "unclear", "none",
)
SUPER_CLASSES = ("optic", "central", "sensory", "visual_projection", "ascending", "descending", "sensory_ascending", "visual_centrifugal", "motor", "endocrine")
#: Class of the second volume -> class of the first; None: it has no counterpart there.
SUPER_CLASS_OF = {
    "ol_intrinsic": "optic",
    "cb_intrinsic": "central",
    "ol_sensory": "sensory",
    "cb_sensory": "sensory",
    "cb_sensory_tbc": "sensory",
    "visual_projection": "visual_projection",
    "visual_projection_tbc": "visual_projection",
    "visual_centrifugal": "visual_centrifugal",
    "ascending_neuron": "ascending",
    "descending_neuron": "descending",
    "descending_neuron_tbc": "descending",
    "sensory_ascending": "sensory_ascending",
    "sensory_ascending_tbc": "sensory_ascending",
    "cb_motor": "motor",
    "cb_endocrine": "endocrine",
    "cb_efferent": None,
    "sensory_descending": None,
    "efferent_ascending": None,
    "efferent_descending": None,
    "ENS": None,
    "vnc_intrinsic": None,
    "vnc_sensory": None,
    "vnc_sensory_tbc": None,
    "vnc_motor": None,
    "vnc_efferent": None,
    "vnc_endocrine": None,
    "vnc_tbc": None,
}
SIDES = {"L": "left", "R": "right", "M": "center"}
