"""Registries, zone labels, baselines and vocabularies."""

# Key, dimension, minimum sample, minimum coverage, five zone labels from low to high.
ELEMENTS = (
    ("hero_pool_breadth", "hero_identity", 30, 0.0, ("Focused", "Selective", "Mixed", "Varied", "Wide")),
    ("hero_pool_stability", "hero_identity", 60, 0.0, ("Restless", "Shifting", "Mixed", "Settled", "Steady")),
    ("hero_exploration_rate", "hero_identity", 60, 0.0, ("Comfort", "Familiar", "Open", "Curious", "Experimental")),
    ("toolkit_breadth", "hero_identity", 30, 0.80, ("Compact", "Focused", "Mixed", "Versatile", "Diverse")),
    (
        "post_loss_familiarity_shift",
        "hero_identity",
        30,
        0.0,
        ("Branches out", "Explores", "Unchanged", "Returns", "Comfort pick"),
    ),
    ("role_breadth", "role_identity", 30, 0.40, ("Anchored", "Centered", "Mixed", "Flexible", "Fluid")),
    ("combat_involvement", "combat_expression", 30, 0.0, ("Quiet", "Selective", "Present", "Active", "Everywhere")),
    ("finisher_orientation", "combat_expression", 30, 0.0, ("Setup", "Support", "Split", "Closer", "Cleanup")),
    ("death_exposure", "risk_survival", 30, 0.0, ("Elusive", "Safe", "Mixed", "Exposed", "Frequent")),
    ("off_pool_performance", "adaptability", 40, 0.0, ("Falls off", "Slips", "Holds", "Travels", "Carries over")),
    (
        "off_pool_activity_stability",
        "adaptability",
        24,
        0.0,
        ("Changes shape", "Shifts", "Similar", "Holds", "Unchanged"),
    ),
    ("performance_volatility", "consistency_form", 30, 0.0, ("Rock solid", "Steady", "Variable", "Swingy", "Wild")),
    ("recent_form_shift", "consistency_form", 45, 0.0, ("Sliding", "Cooling", "Flat", "Rising", "Surging")),
    ("recent_activity_shift", "consistency_form", 45, 0.0, ("Quieter", "Calmer", "Same", "Busier", "Full tilt")),
    ("session_length_tendency", "session_response", 25, 0.0, ("Burst", "Short", "Medium", "Long", "Marathon")),
    (
        "late_session_performance",
        "session_response",
        27,
        0.0,
        ("Drops", "Fades", "Holds", "Warms up", "Finishes strong"),
    ),
    (
        "post_loss_activity_shift",
        "session_response",
        30,
        0.0,
        ("Pulls back", "Quieter", "Same", "Speeds up", "Accelerates"),
    ),
    (
        "post_loss_performance_response",
        "session_response",
        30,
        0.0,
        ("Drops", "Slips", "Holds", "Recovers", "Surges"),
    ),
)
ELEMENT_KEYS = tuple(e[0] for e in ELEMENTS)

# Expected activity per minute, kill share and deaths per ten minutes by role.
ROLE_ACTIVITY = {
    "carry": 0.95,
    "mid": 0.95,
    "offlane": 0.9,
    "jungle": 0.88,
    "soft_support": 0.85,
    "hard_support": 0.78,
    "roamer": 0.95,
}
ROLE_ACTIVITY_DEFAULT = 0.88
ROLE_KILL_SHARE = {
    "carry": 0.55,
    "mid": 0.52,
    "offlane": 0.42,
    "jungle": 0.4,
    "soft_support": 0.34,
    "hard_support": 0.25,
    "roamer": 0.4,
}
ROLE_KILL_SHARE_DEFAULT = 0.4
ROLE_DEATHS = {"carry": 0.72, "mid": 0.78, "offlane": 0.95, "jungle": 0.85, "roamer": 1.05}
ROLE_DEATHS_DEFAULT = 0.85

# The traits that can be the primary function of a hero.
FUNCTION_TRAITS = (
    "initiation",
    "mobility",
    "pickoff",
    "teamfight",
    "save",
    "sustain",
    "burst",
    "sustained_damage",
    "wave_clear",
    "push",
    "frontline",
    "scaling",
    "global_presence",
    "repositioning",
)

SESSION_BUCKETS = ("G1", "G2", "G3", "G4", "G5+")
BASELINE_LEVELS = ("hero_role_function", "hero_function", "function", "role", "overall")

# Key, kind, dimensions, required elements, family, tier, and the OR-of-AND zone clauses.
PATTERNS = (
    (
        "same_playbook",
        "identity",
        ("hero_identity",),
        ("hero_pool_breadth", "toolkit_breadth"),
        "breadth_toolkit",
        "A",
        ((("hero_pool_breadth", ("Varied", "Wide")), ("toolkit_breadth", ("Compact", "Focused"))),),
    ),
    (
        "comfort_edge",
        "contradiction",
        ("hero_identity", "adaptability"),
        ("hero_pool_breadth", "off_pool_performance"),
        "breadth_transfer",
        "A",
        ((("hero_pool_breadth", ("Varied", "Wide")), ("off_pool_performance", ("Slips", "Falls off"))),),
    ),
    (
        "partial_transfer",
        "contradiction",
        ("combat_expression", "adaptability"),
        ("off_pool_activity_stability", "off_pool_performance"),
        "presence_transfer",
        "A",
        ((("off_pool_activity_stability", ("Holds", "Unchanged")), ("off_pool_performance", ("Slips", "Falls off"))),),
    ),
    (
        "versatile_core",
        "identity",
        ("hero_identity",),
        ("hero_pool_breadth", "toolkit_breadth"),
        "breadth_toolkit",
        "A",
        ((("hero_pool_breadth", ("Focused", "Selective")), ("toolkit_breadth", ("Versatile", "Diverse"))),),
    ),
    (
        "proven_flexibility",
        "edge",
        ("hero_identity", "adaptability"),
        ("hero_pool_breadth", "off_pool_performance"),
        "breadth_transfer",
        "A",
        ((("hero_pool_breadth", ("Varied", "Wide")), ("off_pool_performance", ("Travels", "Carries over"))),),
    ),
    (
        "bounceback",
        "edge",
        ("session_response", "hero_identity"),
        ("post_loss_performance_response", "post_loss_familiarity_shift", "post_loss_activity_shift"),
        "post_loss_recovery",
        "B",
        (
            (
                ("post_loss_performance_response", ("Recovers", "Surges")),
                ("post_loss_familiarity_shift", ("Branches out", "Explores", "Returns", "Comfort pick")),
            ),
            (
                ("post_loss_performance_response", ("Recovers", "Surges")),
                ("post_loss_activity_shift", ("Pulls back", "Quieter", "Speeds up", "Accelerates")),
            ),
        ),
    ),
    (
        "performance_slide",
        "leak",
        ("session_response", "hero_identity"),
        ("post_loss_performance_response", "post_loss_familiarity_shift", "post_loss_activity_shift"),
        "post_loss_recovery",
        "B",
        (
            (
                ("post_loss_performance_response", ("Drops", "Slips")),
                ("post_loss_familiarity_shift", ("Branches out", "Explores", "Returns", "Comfort pick")),
            ),
            (
                ("post_loss_performance_response", ("Drops", "Slips")),
                ("post_loss_activity_shift", ("Pulls back", "Quieter", "Speeds up", "Accelerates")),
            ),
        ),
    ),
    (
        "controlled_presence",
        "style",
        ("combat_expression", "risk_survival"),
        ("combat_involvement", "death_exposure"),
        "involvement_deaths",
        "B",
        ((("combat_involvement", ("Active", "Everywhere")), ("death_exposure", ("Elusive", "Safe"))),),
    ),
    (
        "presence_tax",
        "leak",
        ("combat_expression", "risk_survival"),
        ("combat_involvement", "death_exposure"),
        "involvement_deaths",
        "B",
        ((("combat_involvement", ("Active", "Everywhere")), ("death_exposure", ("Exposed", "Frequent"))),),
    ),
    (
        "session_fade",
        "leak",
        ("session_response",),
        ("session_length_tendency", "late_session_performance"),
        "session_drift",
        "B",
        ((("session_length_tendency", ("Long", "Marathon")), ("late_session_performance", ("Drops", "Fades"))),),
    ),
    (
        "session_rise",
        "edge",
        ("session_response",),
        ("session_length_tendency", "late_session_performance"),
        "session_drift",
        "B",
        (
            (
                ("session_length_tendency", ("Medium", "Long", "Marathon")),
                ("late_session_performance", ("Warms up", "Finishes strong")),
            ),
        ),
    ),
)
PATTERN_MINIMUM_CONFIDENCE = 0.45

# Direction of a qualified pattern; the two recovery patterns depend on the clause.
PATTERN_DIRECTIONS = {
    "same_playbook": "hero_names_change_toolkit_holds",
    "comfort_edge": "wide_pool_results_slip_off_pool",
    "partial_transfer": "presence_holds_results_slip",
    "versatile_core": "focused_pool_varied_toolkit",
    "proven_flexibility": "wide_pool_results_travel",
    "controlled_presence": "active_with_controlled_exposure",
    "presence_tax": "active_with_presence_tax",
    "session_fade": "late_session_decline",
    "session_rise": "late_session_improvement",
}
DIMENSIONS = (
    "hero_identity",
    "role_identity",
    "combat_expression",
    "risk_survival",
    "adaptability",
    "consistency_form",
    "session_response",
)

# Functional jobs, demand families, aliases, coverage families, and families by role.
JOBS = (
    "initiation",
    "counter_initiation",
    "catch",
    "fight_control",
    "frontline",
    "save",
    "sustain",
    "forced_movement",
    "repositioning",
    "mobility",
    "burst",
    "sustained_damage",
    "wave_clear",
    "push",
    "global_presence",
    "vision",
    "scaling",
)
DEMANDS = ("commitment", "access", "repositioning", "economy", "timing", "execution", "exposure", "micro")
JOB_ALIASES = {
    "teamfight": "fight_control",
    "teamfight_control": "fight_control",
    "pickoff": "catch",
    "displacement": "forced_movement",
    "global_pressure": "global_presence",
    "damage": "sustained_damage",
}
FAMILIES = {
    "engage_control": ("initiation", "counter_initiation", "catch", "fight_control", "forced_movement"),
    "frontline_protection": ("frontline", "save", "sustain"),
    "damage_finish": ("burst", "sustained_damage", "scaling"),
    "map_objectives": ("wave_clear", "push", "global_presence", "vision"),
    "mobility_reach": ("mobility", "repositioning"),
}
ROLE_FAMILIES = {
    "carry": ("engage_control", "damage_finish", "map_objectives", "mobility_reach"),
    "mid": ("engage_control", "frontline_protection", "damage_finish", "map_objectives", "mobility_reach"),
    "offlane": ("engage_control", "frontline_protection", "damage_finish", "map_objectives", "mobility_reach"),
    "soft_support": ("engage_control", "frontline_protection", "map_objectives", "mobility_reach"),
    "hard_support": ("engage_control", "frontline_protection", "map_objectives", "mobility_reach"),
    "roamer": ("engage_control", "frontline_protection", "map_objectives", "mobility_reach"),
    "jungle": ("damage_finish", "map_objectives", "mobility_reach"),
}
ROLE_POSITIONS = {
    "carry": "1",
    "mid": "2",
    "offlane": "3",
    "soft_support": "4",
    "roamer": "4",
    "hard_support": "5",
}
