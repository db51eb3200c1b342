"""Words of rendered texts, in one place.

They are our own and nothing reads them back; what a consumer must match (verdict
and severity names, icons, colours, payload fields) is in :mod:`revlens.schemas`.
"""

from __future__ import annotations

from revlens.schemas import PRODUCT

# file and inline comments
FILE_TITLE = (f"### {PRODUCT}: `", "`")
NOTHING_FOUND = "Nothing to report here."
PROPOSAL = "_Proposal:_ "
FILE_END = f"<sub>{PRODUCT} wrote this without a person looking at it.</sub>"

# the text of a file's findings for a summary
TEXT_FILE = "File "
TEXT_PROPOSAL = " Proposal: "
TEXT_FIX = " Code: "

# pull requests
SUMMARY_TITLE = f"### {PRODUCT}: result of this pull request"
WITH_FINDINGS = "Result: findings to look at"
WITHOUT_FINDINGS = "Result: no findings"
SUMMARY_END = f"<sub>{PRODUCT}, from the file results alone.</sub>"
NO_FILES = f"{PRODUCT}: this pull request changes no file that can be reviewed."

# notifications
CRITICAL_LINE = "Critical findings, to be fixed before a merge"
HIGH_LINE = "Findings of high severity"
CLEAR_LINE = "Nothing critical or high"
NOTICE_TITLE = f"{PRODUCT} is through with a pull request"
NOTICE_WHERE = ("In `", "`: ")
NOTICE_TOTAL = "All: "
NOTICE_BUTTON = "Open it"
DONE = (f" {PRODUCT} is through with <", " number ", ">")
DONE_VERDICT = "Result: "
DONE_FILES = "Files read: "
FAILED = (f"{PRODUCT} could not finish ", " number ", ", run ", "; the dead letters tell why.")

# prompts
PAST_TITLE = "Findings on similar code of this repository:"
RULES_TITLE = "Rules of the team for this language:"
NO_CONTEXT = "This repository has no findings or rules so far."
NO_FUNCTIONS = "no functions in the added lines"
