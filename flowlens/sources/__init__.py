"""Reading source trees and index snapshots."""
