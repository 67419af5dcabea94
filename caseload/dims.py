"""Names, ids, lists and schedules that decide how rows are labelled."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values. Support team, in report order.
SUPPORT_TEAM = ["Bhushan", "Girly", "Nova", "Francis"]
REPORT_AGENTS = ["Nova", "Girly", "Francis", "Bhushan"]

# Fixed values. Ticket owner alias -> real name.
STAFF_ALIASES = {
    "Girly E": "Girly",
    "Gillie E": "Girly",
    "Gillie": "Girly",
    "Nora N": "Nova",
    "Nora": "Nova",
    "Chris S": "Francis",
    "Chris": "Francis",
    "Shan D": "Bhushan",
    "Shan": "Bhushan",
}

# Fixed values. Lower-case owner text -> team member; anything else is not a team member.
TEAM_NAMES = {
    "nora": "Nova",
    "nora n": "Nova",
    "nova": "Nova",
    "gillie": "Girly",
    "gillie e": "Girly",
    "girly": "Girly",
    "girly e": "Girly",
    "shan": "Bhushan",
    "shan d": "Bhushan",
    "bhushan": "Bhushan",
    "chris": "Francis",
    "chris s": "Francis",
    "francis": "Francis",
}
NON_TEAM_WORDS = ["spencer", "erin", "richie", "test", "admin"]

# Fixed values. Pipeline id -> label.
PIPELINE_LABELS = {
    "0": "Support Pipeline",
    "147307289": "Live Chat",
    "648529801": "Upgrades/Downgrades",
    "667370066": "Success",
    "724973238": "Customer Onboarding",
    "76337708": "Dev Tickets",
    "77634704": "Marketing, Finance",
    "803109779": "Product Testing Requests - Enterprise",
    "803165721": "Trial Account Requests - Enterprise",
    "95256452": "Enterprise and VIP Tickets",
    "95947431": "SPAM Tickets",
}
SPAM_PIPELINE = "SPAM Tickets"
LIVE_CHAT = "Live Chat"
LIVE_CHAT_SPACED = "Live Chat "
LIVE_CHAT_RESPONSE_SECONDS = 30
LIVE_CHAT_DISPLAY_HOURS = 0.008

# Fixed values. Pipeline label -> short display label.
PIPELINE_DISPLAY = {
    "Support Pipeline": "Support",
    "Enterprise and VIP Tickets": "Enterprise/VIP",
    "Dev Tickets": "Dev",
}
SPAM_DISPLAY = "SPAM"


@dataclass(frozen=True)
class AgentRegistry:
    """Who is a bot, who is a person, and under which name each one is shown.

    Site-specific bots are added with ``with_bots``; the defaults are the names every report knows.
    """

    # Fixed values. Bot name -> display name.
    bots: dict[str, str] = field(
        default_factory=lambda: {
            "Wynn AI": "Wynn AI",
            "Sales Agent": "Wynn AI",
            "Agent Scrape": "Agent Scrape",
            "ChatBot": "Agent Scrape",
            "Customer Support TEST Bot": "Test Bot",
        }
    )
    # Fixed values. Human agent name -> display name.
    humans: dict[str, str] = field(
        default_factory=lambda: {
            "Shan": "Bhushan",
            "Girly": "Girly",
            "Chris": "Francis",
            "Nora": "Nova",
            "Gillie": "Girly",
            "Bhushan": "Bhushan",
            "Francis": "Francis",
            "Nova": "Nova",
        }
    )
    # Fixed values. Bot ids that the agent directory may lack.
    bot_ids: dict[str, str] = field(
        default_factory=lambda: {
            "5626186ef1d50006d82a02372509ec3e": "Agent Scrape",
            "ce8545b838652bea3889eafd72a6d821": "Wynn AI",
            "9b96f9b272d4666b95cc74bb8bbd4131": "Agent Scrape",
        }
    )

    def with_bots(self, extra: dict[str, str]) -> "AgentRegistry":
        return AgentRegistry({**self.bots, **extra}, dict(self.humans), dict(self.bot_ids))


AGENTS = AgentRegistry()

# Fixed values. Words that mark an agent name as a bot when no registry entry is available.
REPAIR_BOT_WORDS = ["ai", "bot", "wynn"]
METRIC_BOT_WORDS = ["bot", "ai", "wynn", "scrape", "automated"]
METRIC_BOT_NAMES = ["Wynn AI", "Agent Scrape", "Bot", "Chatbot"]

TRANSFER_TAG = "chatbot-transfer"

# Fixed values. Text tokens read as missing in ticket files.
NULL_TOKENS = ["", "NULL", "null", "None"]

_WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def _working_week(start: str, end: str, days: int = 5, friday_end: str | None = None) -> dict:
    week = {day: [(start, end)] if i < days else [] for i, day in enumerate(_WEEKDAYS)}
    if friday_end:
        week["friday"] = [(start, friday_end)]
    return week


# Fixed values. Shift schedule in Eastern time; the last entry applies to agents without their own.
SHIFT_SCHEDULE = {
    "Nova": _working_week("11:00", "19:00", friday_end="18:00"),
    "Girly": _working_week("09:00", "17:00"),
    "Bhushan": _working_week("05:00", "13:00"),
    "Francis": _working_week("19:00", "05:00", days=4),
}
FALLBACK_SHIFTS = _working_week("05:00", "19:00", friday_end="18:00")
SHIFT_BUFFER_MINUTES = 30

# Fixed values. Quality-review columns of the export.
QA_FIELDS = [
    "QA - Evaluator Name",
    "QA - Ticket ID",
    "QA - Channel",
    "QA - Date of Interaction",
    "QA - 1. Revenue Opportunity",
    "QA - 2. SLA Adherence",
    "QA - 2a.",
    "QA - 3. SLA Miss Reason",
    "QA - 4. Unnecessary Interactions",
    "QA - 5. Technical Accuracy & Problem Resolution",
    "QA - 5a.",
    "QA - 6. Communication & Professionalism",
    "QA - 6a.",
    "QA - 7. Customer Service & Experience",
    "QA - 7a.",
    "QA - 8. Process Adherence & Efficiency",
    "QA - 8a.",
    "QA - 9. Case Management & Documentation",
    "QA - 9a.",
    "QA - 10. Customer Growth & Health",
    "QA - 10a.",
    "QA - 11. Revenue Impact Assessment",
    "QA - 12. Identified Root Cause",
    "QA - 12a.",
    "QA - 13. Suggestions for Deflection",
    "QA - 14. Tag for Systemic Review?",
    "QA - 15. Additional Comments / Coaching",
    "QA - Overall Performance Rating",
]
